"""Text and identity functions as columns.

Each normalizer has its own rule; they are not interchangeable.  Nulls give
nulls unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quotation marks and what they are mapped to.
QUOTES, PLAIN_QUOTES = "‘’‚‛“”„‟", "''''\"\"\"\""
#: ASCII punctuation that answers lose.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = r"[\p{L}\p{N}_]+"


def fold(text: Column) -> Column:
    """Lower case with sharp s written out, as case folding does for these languages."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tokenize(text: Column) -> Column:
    """Unicode words, folded, in order and with repeats."""
    return F.regexp_extract_all(fold(text), F.lit(f"({WORD})"), F.lit(1))


def search_text(title: Column, body: Column) -> Column:
    return F.concat_ws(" ", title, body)


def document_text(title: Column, body: Column) -> Column:
    """A paragraph as embedding providers get it."""
    return F.concat(F.lit("Title: "), title, F.lit("\nText: "), body)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def matching_text(text: Column) -> Column:
    """Plain quotes, single spaces, case kept."""
    return collapse(F.translate(text, QUOTES, PLAIN_QUOTES))


def question_key(text: Column) -> Column:
    return fold(matching_text(text))


def entity_key(text: Column) -> Column:
    """Folded letters and digits of any script, single spaces."""
    return collapse(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "))


def ascii_key(text: Column) -> Column:
    """Lower-case ASCII letters and digits, single spaces."""
    return collapse(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def spaced_key(text: Column) -> Column:
    """Folded, underscores as spaces."""
    return collapse(F.replace(fold(text), F.lit("_"), F.lit(" ")))


def dashed_key(text: Column) -> Column:
    """Folded, underscores and hyphens as spaces."""
    return collapse(F.translate(fold(text), "_-", "  "))


def anchor_key(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), " ")


def answer_key(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single spaces."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    return collapse(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def estimated_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4)


def stable_digest(*parts: Column) -> Column:
    """SHA-256 over each part's UTF-8 length in eight bytes and its bytes."""
    return digest_of(F.array(*[p.cast("string") for p in parts]))


def digest_of(parts: Column) -> Column:
    hexed = F.transform(parts, lambda x: F.concat(F.lpad(F.hex(F.octet_length(x)), 16, "0"), F.hex(F.encode(x, "UTF-8"))))
    return F.sha2(F.unhex(F.array_join(hexed, "")), 256)


def chunk_id(title: Column, sentences: Column) -> Column:
    return F.concat(F.lit("chunk:"), digest_of(F.concat(F.array(title), sentences)))


def path_id(prefix: Column, nodes: Column, edges: Column) -> Column:
    return F.concat(prefix, F.lit("::"), F.substring(F.sha1(F.concat_ws("|", prefix, nodes, edges)), 1, 12))


def rounded(x: Column, places: int = 6) -> Column:
    return F.round(x, places)


def _accents() -> tuple[str, str]:
    """Latin letters whose compatibility form is one ASCII letter and marks, and those ASCII letters."""
    import unicodedata

    marked, bare = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(base) == 1:
            marked.append(chr(code))
            bare.append(base)
    return "".join(marked), "".join(bare)


MARKED, BARE = _accents()


def graph_key(text: Column) -> Column:
    """ASCII letters and digits with accents dropped, joined by underscores; ``unknown`` if nothing is left."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARKED, BARE), r"[^\x00-\x7F]", "")
    key = F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(key == "", "unknown").otherwise(key)


def node_id(kind: str, label: Column) -> Column:
    return F.concat(F.lit(kind + "::"), graph_key(label))


def sentence_node(unit_id: Column) -> Column:
    return F.concat(F.lit("sentence::"), unit_id)


def edge_id(kind: Column, source: Column, target: Column, unit: Column, relation: Column) -> Column:
    return F.concat(F.lit("edge::"), kind, F.lit("::"), source, F.lit("::"), target, F.lit("::evidence::"), graph_key(F.coalesce(unit, F.lit("global"))), F.lit("::relation::"), graph_key(F.coalesce(relation, F.lit("none"))))
