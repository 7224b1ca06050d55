"""Places in text as columns: words with offsets, names, and trigger phrases.

A text becomes an array of ``(w, a, b, gap)``: a match, where it begins and
ends (from 0, end left out), and what follows it up to the next match.  All
rules look at such arrays by position, so they stay inside the JVM and work
on any number of rows at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import text as T

MATCH = "array<struct<w:string,a:int,b:int,gap:string>>"
NAME = "array<struct<text:string,normalized:string,source:string,start:int,end:int,confidence:double>>"
HIT = "array<struct<relation:string,matched_text:string,start:int,end:int>>"

#: Words that are no name by themselves.
NO_NAMES = (
    "a an are because between did do does during from how in is the this was were what when where which who whom whose"
).split()
#: Words that may stand between two parts of a name.
JOINING = "at da de del der di du for in la le of on the van von".split()
#: How far a name is trusted by where it comes from.
NAME_SCORES = {"quoted_string": 0.98, "capitalized_phrase": 0.90, "title_like_token": 0.70}

LETTER_WORD = r"\p{L}[\p{L}\p{N}_’'-]*"
WORD = r"[\p{L}\p{N}_]+"
QUOTED = r"\"[^\"]+\"|(?<![\p{L}\p{N}_])'[^']+'(?![\p{L}\p{N}_])"
_OPEN, _CLOSE = "\u0001", "\u0002"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def none_of(kind: str) -> Column:
    return F.array().cast(kind)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern in order, as ``(w, a, b, gap)``."""
    plain = F.translate(F.coalesce(text, F.lit("")), _OPEN + _CLOSE, "  ")
    pieces = F.split(F.regexp_replace(plain, f"({pattern})", f"{_OPEN}$1{_CLOSE}"), _OPEN)

    def add(acc: Column, piece: Column) -> Column:
        word = F.substring_index(piece, _CLOSE, 1)
        row = F.struct(word.alias("w"), acc["at"].alias("a"), (acc["at"] + F.length(word)).alias("b"), F.substring(piece, F.length(word) + 2, F.length(piece)).alias("gap"))
        return F.struct((acc["at"] + F.length(piece) - 1).cast("int").alias("at"), F.concat(acc["out"], F.array(row)).cast(MATCH).alias("out"))

    def of(ps: Column) -> Column:
        # block by block, so that a long text costs its length and not its square
        starts = F.when(F.size(ps) > 1, F.sequence(F.lit(1), F.size(ps) - 1, F.lit(BLOCK))).otherwise(none_of("array<int>"))
        empty = F.struct(F.lit(0).alias("at"), none_of(MATCH).alias("out"))
        blocks = F.transform(starts, lambda k: F.aggregate(F.slice(ps, k + 1, F.lit(BLOCK)), empty, add))
        return let(blocks, lambda bs: let(offsets(F.length(F.get(ps, F.lit(0))), bs["at"]), lambda at: F.flatten(F.transform(bs, lambda x, i: F.transform(x["out"], lambda m: _moved(m, F.get(at, i)))))))

    return let(pieces, of).cast(MATCH)


#: Pieces that are put together at once.
BLOCK = 64


def _moved(m: Column, by: Column) -> Column:
    return F.struct(m["w"].alias("w"), (m["a"] + by).alias("a"), (m["b"] + by).alias("b"), m["gap"].alias("gap"))


def offsets(first: Column, sizes: Column) -> Column:
    """Where each of some stretches begins, the first at ``first``."""
    start = F.array(first.cast("int"))
    return F.aggregate(sizes, start, lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n).cast("int"))))


def capital(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return (F.upper(first) == first) & (F.lower(first) != first)


def holds(flags: Column, at: Column) -> Column:
    """A flag of an array, false outside it."""
    return F.coalesce(F.get(flags, at), F.lit(False))


def places(of: Column) -> Column:
    """Numbers of the elements of an array."""
    return F.when(F.size(of) > 0, F.sequence(F.lit(0), F.size(of) - 1)).otherwise(none_of("array<int>"))


def runs(flags: Column, joins: Column) -> Column:
    """``(s, e)`` of each run of flagged places; two of them may be a single joining place apart."""
    at = places(flags)
    before = lambda k: holds(flags, k - 1) | (holds(joins, k - 1) & holds(flags, k - 2))
    behind = lambda k: holds(flags, k + 1) | (holds(joins, k + 1) & holds(flags, k + 2))
    starts = F.filter(at, lambda k: holds(flags, k) & ~before(k))
    ends = F.filter(at, lambda k: holds(flags, k) & ~behind(k))
    return let(ends, lambda e: F.transform(starts, lambda s, i: F.struct(s.alias("s"), F.get(e, i).alias("e"))))


def _trimmed(span: Column, source: str) -> Column:
    """A span as a name, without a leading word that is no name and without a possessive; null if no name is left."""
    lead = F.substring_index(span["text"], " ", 1)
    cut = F.when(F.contains(span["text"], F.lit(" ")) & F.lower(lead).isin(NO_NAMES), F.length(lead) + 1).otherwise(F.lit(0))

    def name(rest: Column, at: Column) -> Column:
        own = F.lower(F.substring(rest, -2, 2)).isin("'s", "’s")
        text = F.when(own, F.substring(rest, F.lit(1), F.length(rest) - 2)).otherwise(rest)
        key = T.entity_key(text)
        row = F.struct(
            text.alias("text"), key.alias("normalized"), F.lit(source).alias("source"), at.alias("start"), (at + F.length(text)).alias("end"), F.lit(NAME_SCORES[source]).alias("confidence")
        )
        return F.when(~F.lower(rest).isin(NO_NAMES) & (key != "") & ~key.isin(NO_NAMES), row)

    return let(cut, lambda c: name(F.substring(span["text"], c + 1, F.length(span["text"])), (span["a"] + c).cast("int")))


def _names_of(spans: Column, source: str) -> Column:
    return F.filter(F.transform(spans, lambda s: _trimmed(s, source)), lambda n: n.isNotNull()).cast(NAME)


def _apart(spans: Column, taken: Column) -> Column:
    """Spans ``(text, a, b)`` that overlap no name."""
    return F.filter(spans, lambda s: ~F.exists(taken, lambda t: (s["a"] < t["end"]) & (t["start"] < s["b"])))


def first_of(rows: Column, key: Callable[[Column], Column]) -> Column:
    """Elements without those whose key came before; sorted once by key, so long arrays are no trouble."""

    def of(rs: Column) -> Column:
        keyed = F.array_sort(F.transform(rs, lambda r, i: F.struct(key(r).alias("k"), i.alias("i"))))
        firsts = lambda ks: F.filter(ks, lambda x, j: (j == 0) | ~x["k"].eqNullSafe(F.get(ks, j - 1)["k"]))
        return let(keyed, lambda ks: F.transform(F.array_sort(F.transform(firsts(ks), lambda x: x["i"])), lambda i: F.get(rs, i)))

    return let(rows, of)


def all_names(text: Column) -> Column:
    """Names in order of trust: what is quoted, runs of capitalized words, single ones; each place once."""
    piece = lambda a, b: F.struct(F.substring(text, a + 1, b - a).alias("text"), a.alias("a"), b.alias("b"))
    inner = F.transform(matches(text, QUOTED), lambda m: piece(m["a"] + 1, m["b"] - 1))

    def from_words(quoted: Column, words: Column) -> Column:
        big = F.transform(words, lambda m: capital(m["w"]))
        small = F.transform(words, lambda m: F.lower(m["w"]).isin(JOINING))

        def of(found: Column, flags: Column) -> Column:
            a, b = lambda r: F.get(words, r["s"])["a"], lambda r: F.get(words, r["e"])["b"]
            held = lambda r: F.exists(quoted, lambda t: (a(r) < t["end"]) & (t["start"] < b(r)))
            kept = F.filter(found, lambda r: (r["e"] > r["s"]) & ~held(r))
            # words of their own, and those of runs that a quotation breaks up
            rest = F.flatten(F.transform(F.filter(found, lambda r: (r["e"] == r["s"]) | held(r)), lambda r: F.filter(F.sequence(r["s"], r["e"]), lambda k: holds(flags, k))))
            single = _apart(F.transform(rest, lambda k: piece(F.get(words, k)["a"], F.get(words, k)["b"])), quoted)
            return F.concat(quoted, _names_of(F.transform(kept, lambda r: piece(a(r), b(r))), "capitalized_phrase"), _names_of(single, "title_like_token"))

        return let(big, lambda x: let(small, lambda y: let(runs(x, y), lambda found: of(found, x))))

    return let(_names_of(inner, "quoted_string"), lambda quoted: let(matches(text, LETTER_WORD), lambda words: from_words(quoted, words)))


def names(text: Column) -> Column:
    """Names (see ``all_names``), each key once."""
    return first_of(all_names(text), lambda n: n["normalized"])


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def triggers(text: Column, table: dict[str, str], every: bool = False) -> Column:
    """``(relation, matched_text, start, end)`` wherever a phrase of up to three words of the table stands.

    At each word the longest phrase counts, or with ``every`` each that begins there.
    """
    heads = sorted({phrase.split()[0] for phrase in table})
    longest = max(len(phrase.split()) for phrase in table)
    low = F.lower(F.coalesce(text, F.lit("")))

    def found(words: Column) -> Column:
        def hit(k: Column) -> Column:
            one = lambda j: F.get(words, k + j)
            blank = lambda j: one(j)["gap"].rlike(r"^\s+$")
            key, keys, ok = one(0)["w"], [], F.lit(True)
            keys.append((key, one(0)["b"], ok))
            for j in range(1, longest):
                ok = ok & F.coalesce(blank(j - 1), F.lit(False))
                key = F.concat_ws(" ", key, one(j)["w"])
                keys.append((key, one(j)["b"], ok))
            row = lambda name, end: F.struct(name.alias("relation"), F.substring(low, one(0)["a"] + 1, end - one(0)["a"]).alias("matched_text"), one(0)["a"].alias("start"), end.alias("end"))
            hits = [F.when(ok & _lookup(table, key).isNotNull(), row(_lookup(table, key), end)) for key, end, ok in reversed(keys)]
            return F.array(*reversed(hits)) if every else F.array(F.coalesce(*hits))

        at = F.filter(places(words), lambda k: F.get(words, k)["w"].isin(heads))
        return F.filter(F.flatten(F.transform(at, hit)), lambda h: h.isNotNull()).cast(HIT)

    return let(matches(low, WORD), found)
