import hashlib

from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_are_folded_unicode_words(spark):
    assert one(spark, T.tokenize(F.lit("CAFÉ, Apple_2! Straße"))) == ["café", "apple_2", "strasse"]


def test_normalizers_keep_their_own_rules(spark):
    s = F.lit(" The “Straße”_of  Ünder-Way! ")
    assert one(spark, T.matching_text(s)) == 'The "Straße"_of Ünder-Way!'
    assert one(spark, T.entity_key(s)) == "the strasse of ünder way"
    assert one(spark, T.ascii_key(s)) == "the stra e of nder way"
    assert one(spark, T.graph_key(F.lit("Crème Brûlée #2"))) == "creme_brulee_2"
    assert one(spark, T.graph_key(F.lit("中"))) == "unknown"
    assert one(spark, T.dashed_key(F.lit("A_b-C"))) == "a b c"
    assert one(spark, T.answer_key(F.lit("The  London, an England."))) == "london england"


def test_digests_hash_lengths_and_bytes(spark):
    h = hashlib.sha256()
    for part in ("é", "", "b c"):
        h.update(len(part.encode()).to_bytes(8, "big") + part.encode())
    assert one(spark, T.stable_digest(F.lit("é"), F.lit(""), F.lit("b c"))) == h.hexdigest()
    assert one(spark, T.chunk_id(F.lit("é"), F.array(F.lit(""), F.lit("b c")))) == "chunk:" + h.hexdigest()
