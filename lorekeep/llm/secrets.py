"""Secret scan: three patterns and a sliding-window entropy method, native Spark only.

Base kinds, leftmost and non-overlapping: `assign` (a keyword, a separator, a
value of six or more characters), `access` (AKIA keys of 20 or more) and `hex`
(24 or more digits). The entropy method looks at candidate strings of token
characters, takes the character class of each (hex, alphanumeric, base64) and
slides a window over it; counts of the characters in the window are updated
by the one that enters and the one that leaves, and with them the sum of
c*log2(c) from which the entropy follows. Windows at or above the class's
threshold join into `entropy` spans. Candidates that the allow-list matches
are suppressed.

Offsets are code points, ends exclusive. Null and empty texts have no spans.
Rows are independent: repeated rows and ids give repeated results, null ids
stay null, an empty table gives an empty result. Only the id and the results
are returned, so columns of the same names as results do no harm. Long texts
are scanned whole: no pattern repeats a group by backtracking, and the offsets
of n matches take about n to the power of 1.5 steps, not n squared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns.
ASSIGN = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGN_HEAD = r"^(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Candidates of the entropy method, and the class each belongs to.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy, in bits a character, of a window of 20 by class.
THRESHOLDS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
#: What is no secret: words in one case, words joined by dashes, one repeated character, plain numbers, rules, example keys.
#: The repeated group is possessive: it loops without a call a round, and gives nothing up that a later round could take.
ALLOW = [r"^[a-z]+$", r"^[A-Z]+$", r"^[A-Z]?[a-z]+(?:[-_/][A-Za-z]?[a-z]+)*+$", r"^(.)\1+$", r"^[0-9_-]+$", r"^[-=_+/]+$", r"(?i)example"]
#: Matches whose offsets are summed up together.
RUN = 256

KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
SPAN = "struct<start: bigint, rank: int, kind: string, end: bigint>"


def _running(items: Column, size: Column) -> Column:
    """Running totals of pieces and matches: the offset of each match.

    Totals are built run by run: a run's own offsets, then the offset at which
    each run begins. So no array is copied for each of very many matches.
    """
    pair = "struct<at: bigint, starts: array<bigint>>"
    empty = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("starts")).cast(pair)

    def one(acc: Column, s: Column) -> Column:
        return F.struct((acc["at"] + s["p"] + s["m"]).cast("bigint").alias("at"), F.concat(acc["starts"], F.array((acc["at"] + s["p"]).cast("bigint"))).alias("starts"))

    width = F.greatest(F.lit(RUN), F.ceil(F.sqrt(size))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / width).cast("int") - 1)), lambda k: F.aggregate(F.slice(items, k * width + 1, width), empty, one))
    begins = _let(runs, lambda r: F.aggregate(r, empty, lambda acc, x: F.struct((acc["at"] + x["at"]).cast("bigint").alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")), lambda acc: F.zip_with(r, acc["starts"], lambda x, begin: F.transform(x["starts"], lambda s: s + begin))))
    return F.flatten(begins)


def _matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Matches of a pattern and the code-point offset of each.

    The text splits at the matches, so an offset is the length of what stands
    before it: pieces and matches, summed by a running total.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.arrays_zip(found.alias("m"), F.slice(pieces, 1, F.size(found)).alias("p"))
    lengths = F.transform(steps, lambda s: F.struct(F.char_length(s["m"]).alias("m"), F.char_length(s["p"]).alias("p")))
    return found, _let(lengths, lambda items: _running(items, F.size(items)))


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<span> of a kind's matches; texts without one skip the work."""
    found, starts = _matches(text, pattern)
    made = F.transform(F.arrays_zip(found.alias("m"), starts.alias("s")), lambda z: F.struct(z["s"].alias("start"), F.lit(KINDS[kind]).alias("rank"), F.lit(kind).alias("kind"), (z["s"] + F.char_length(z["m"])).cast("bigint").alias("end"), z["m"].alias("match")))
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(f"array<{SPAN[:-1]}, match: string>>"))


def _plogp(count: Column) -> Column:
    """count * log2(count) for a count of 0 to WINDOW, from a table."""
    import math

    table = F.array(*[F.lit(0.0 if c == 0 else c * math.log2(c)) for c in range(WINDOW + 1)])
    return F.element_at(table, (count + 1).cast("int"))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: A window's counts are a string with a letter for each ASCII code: "A" for 0, "B" for 1 and so on.
_NONE = 65


def _count(counts: Column, code: Column) -> Column:
    return F.ascii(F.substring(counts, code + 1, F.lit(1))) - _NONE


def _put(counts: Column, code: Column, count: Column) -> Column:
    return F.overlay(counts, F.char(count + _NONE), code + 1, F.lit(1))


def _hot_windows(candidate: Column, threshold: Column) -> Column:
    """Merged [start, end) intervals of the candidate's windows at or above the threshold."""
    codes = F.transform(F.split(candidate, "", -1), lambda ch: F.ascii(ch))
    entering = F.filter(codes, lambda c: c > 0)
    steps = _let(entering, lambda c: F.arrays_zip(F.sequence(F.lit(0), F.size(c) - 1).alias("i"), c.alias("into"), F.slice(F.concat(F.array_repeat(F.lit(0), WINDOW), c), 1, F.size(c)).alias("out")))
    first = F.struct(F.repeat(F.lit(chr(_NONE)), F.lit(128)).alias("n"), F.lit(0.0).alias("s"), F.array().cast("array<struct<a: int, b: int>>").alias("hot"))

    def step(acc: Column, x: Column) -> Column:
        def entered(c: Column) -> Column:
            return F.struct(_put(acc["n"], x["into"], c + 1).alias("n"), (acc["s"] + _plogp(c + 1) - _plogp(c)).alias("s"))

        def left(y: Column) -> Column:
            gone = _let(_count(y["n"], x["out"]), lambda c: F.struct(_put(y["n"], x["out"], c - 1).alias("n"), (y["s"] + _plogp(c - 1) - _plogp(c)).alias("s")))
            return F.when(x["i"] >= WINDOW, gone).otherwise(y)

        def judged(z: Column) -> Column:
            is_hot = (x["i"] >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - z["s"] / WINDOW >= threshold - 1e-9)
            begin, end = (x["i"] - WINDOW + 1).cast("int"), (x["i"] + 1).cast("int")
            last = F.try_element_at(acc["hot"], F.lit(-1))
            fresh = F.struct(begin.alias("a"), end.alias("b"))
            wider = F.concat(F.slice(acc["hot"], 1, F.size(acc["hot"]) - 1), F.array(F.struct(last["a"].alias("a"), end.alias("b"))))
            joined = F.when((F.size(acc["hot"]) > 0) & (last["b"] >= begin), wider).otherwise(F.concat(acc["hot"], F.array(fresh)))
            return F.struct(z["n"].alias("n"), z["s"].alias("s"), F.when(is_hot, joined).otherwise(acc["hot"]).alias("hot"))

        return _let(_let(_let(_count(acc["n"], x["into"]), entered), left), judged)

    return F.aggregate(steps, first, step, lambda a: a["hot"])


def _entropy_spans(candidate: Column, start: Column) -> Column:
    threshold = F.when(candidate.rlike("^[0-9a-fA-F]+$"), THRESHOLDS["hex"]).when(candidate.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    return F.transform(_hot_windows(candidate, threshold), lambda w: F.struct((start + w["a"]).cast("bigint").alias("start"), F.lit(3).alias("rank"), F.lit("entropy").alias("kind"), (start + w["b"]).cast("bigint").alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: counts by base kind, the base spans' digest, all spans."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")
    d = docs.select(F.col(f"`{id_col}`"), text)
    assign = F.filter(_spans(F.col("t"), "assign", ASSIGN), lambda s: F.char_length(F.regexp_replace(s["match"], ASSIGN_HEAD, "")) >= 6)
    d = d.select(id_col, assign.alias("assign"), _spans(F.col("t"), "access", ACCESS).alias("access"), _spans(F.col("t"), "hex", HEX).alias("hex"), _spans(F.col("t"), "entropy", CANDIDATE).alias("candidates"))
    allowed = lambda s: reduce(lambda a, b: a | b, [s["match"].rlike(p) for p in ALLOW])
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    extra = F.when(F.size("candidates") > 0, F.flatten(F.transform(F.filter("candidates", lambda s: ~allowed(s)), lambda s: _entropy_spans(s["match"], s["start"])))).otherwise(F.array().cast(f"array<{SPAN}>"))
    d = d.select(id_col, F.size("assign").cast("bigint").alias("n_assign"), F.size("access").cast("bigint").alias("n_access"), F.size("hex").cast("bigint").alias("n_hex"), F.concat(plain(F.col("assign")), plain(F.col("access")), plain(F.col("hex"))).alias("base"), extra.alias("extra"))
    return d.select(id_col, "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans"))
