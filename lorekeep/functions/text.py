"""Text functions: Column in, Column out, built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with accents and the letters they fold to (ours, from Unicode decompositions).
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

#: Our own stop words.
STOP = ["the", "of", "and", "to", "in", "is", "it", "that", "for", "as", "with", "by", "on", "at", "an", "be", "are", "was", "this", "from", "or", "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "est", "que", "qui", "dans", "pour", "par", "sur"]

WORDS = r"([\p{L}\p{N}]+)"


def fold(c: Column) -> Column:
    """Accents off; the ligatures become two letters."""
    out = F.translate(c, ACCENTED, PLAIN)
    for a, b in (("œ", "oe"), ("æ", "ae"), ("Œ", "OE"), ("Æ", "AE")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORDS), F.lit(1))


def ident_tokens(c: Column) -> Column:
    """Parts of an identifier at separators and case changes, then the whole; two letters at least."""
    split = F.regexp_replace(F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.transform(F.split(split, r"[_\-./ ]+"), lambda x: F.lower(x))
    return F.array_distinct(F.filter(F.concat(parts, F.array(F.lower(c))), lambda x: F.char_length(x) >= 2))


def free_tokens(c: Column, cap: int = 250) -> Column:
    """Folded words of free text without stop words, numbers and single letters."""
    found = F.filter(words(fold(c)), lambda x: (F.char_length(x) >= 2) & ~x.rlike(r"^\d+$") & ~F.array_contains(F.lit(STOP), x))
    return F.slice(found, 1, cap)


#: Suffixes of the light stemmer, longest first, with the least letters that must remain (ours).
SUFFIXES = [("ization", 3), ("issement", 3), ("ations", 3), ("ation", 3), ("ments", 3), ("ment", 3), ("ness", 3), ("tion", 3), ("ing", 3), ("ity", 3), ("ed", 4), ("er", 4), ("ly", 3)]


def stem(c: Column) -> Column:
    """Plural off, then one suffix off, doubled consonant undone, silent e off; [a-z]{5,} only."""
    base = F.when(c.rlike("ies$"), F.regexp_replace(c, "ies$", "y")).when(c.rlike("[^s]s$"), F.regexp_replace(c, "s$", "")).otherwise(c)
    out = None
    for suffix, least in SUFFIXES:
        hit = base.rlike(f"^.{{{least},}}{suffix}$")
        cut = F.regexp_replace(base, f"{suffix}$", "")
        if suffix in ("ing", "ed", "er"):
            cut = F.when(cut.rlike("(bb|dd|gg|ll|mm|nn|pp|rr|tt)$"), F.substring(cut, F.lit(1), F.char_length(cut) - 1)).otherwise(cut)
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    out = out.otherwise(F.when(base.rlike("^.{4,}e$"), F.regexp_replace(base, "e$", "")).otherwise(base))
    return F.when(c.rlike("^[a-z]{5,}$"), out).otherwise(c)


def stem_word(w: str) -> str:
    """stem() of one word of ASCII letters."""
    if len(w) < 5:
        return w
    if w.endswith("ies"):
        w = w[:-3] + "y"
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    for suffix, least in SUFFIXES:
        if w.endswith(suffix) and len(w) >= least + len(suffix):
            w = w[: -len(suffix)]
            return w[:-1] if suffix in ("ing", "ed", "er") and w[-2:] in ("bb", "dd", "gg", "ll", "mm", "nn", "pp", "rr", "tt") else w
    return w[:-1] if w.endswith("e") and len(w) >= 5 else w


def stem_sql(x: str) -> str:
    base = f"(CASE WHEN regexp_matches({x}, 'ies$') THEN regexp_replace({x}, 'ies$', 'y') WHEN regexp_matches({x}, '[^s]s$') THEN regexp_replace({x}, 's$', '') ELSE {x} END)"
    whens = []
    for suffix, least in SUFFIXES:
        cut = f"regexp_replace({base}, '{suffix}$', '')"
        if suffix in ("ing", "ed", "er"):
            cut = f"(CASE WHEN regexp_matches({cut}, '(bb|dd|gg|ll|mm|nn|pp|rr|tt)$') THEN left({cut}, length({cut}) - 1) ELSE {cut} END)"
        whens.append(f"WHEN regexp_matches({base}, '^.{{{least},}}{suffix}$') THEN {cut}")
    inner = f"CASE {' '.join(whens)} WHEN regexp_matches({base}, '^.{{4,}}e$') THEN regexp_replace({base}, 'e$', '') ELSE {base} END"
    return f"(CASE WHEN regexp_matches({x}, '^[a-z]{{5,}}$') THEN {inner} ELSE {x} END)"


def slug(c: Column) -> Column:
    """Heading to anchor."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold(c)), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def token_cost(c: Column) -> Column:
    """Tokens a text costs: a quarter of its characters, rounded up."""
    return F.ceil(F.char_length(c) / 4).cast("bigint")


def glob_regex(glob: str) -> str:
    """Regular expression of a glob; stars cross slashes, a leading **/ may match nothing."""
    import re

    lead = glob.startswith("**/")
    body = glob[3:] if lead else glob
    out = "".join(".*" if p and p[0] == "*" else "." if p == "?" else re.escape(p) for p in re.findall(r"\*+|\?|[^*?]", body))
    return "^" + ("(.*/)?" if lead else "") + out.replace("\\/", "/") + "$"


def norm_line(c: Column) -> Column:
    """A log line's shape: trimmed, 160 characters, free-standing numbers as #, runs of space narrowed."""
    cut = F.substring(F.trim(c), 1, 160)
    marked = F.regexp_replace(F.regexp_replace(cut, r"\b\d+\b", "#"), r"[ _]{2,}", "  ")
    return marked


ANSI = "\x1b\\[[0-9;?]*[A-Za-z]"


def strip_ansi(c: Column) -> Column:
    return F.regexp_replace(c, ANSI, "")


TEST_PATH = r"(^|/)(tests?|__tests__|spec)(/|$)|(_test|\.test|\.spec|_spec)\.[a-z]+$|(^|/)test_[^/]*$"
#: Extensions of configuration and schema files, in either case.
CONFIG_PATH = r"(?i)(^|\.)(sql|yml|yaml|toml|json)$"


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_config(path: Column) -> Column:
    return path.rlike(CONFIG_PATH)
