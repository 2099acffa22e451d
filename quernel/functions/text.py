"""Text functions of curation and evaluation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens of a molecular string.
TOKEN = (
    r"(\[[^\]]+]|Br?|Cl?|Si|Se|Na|Li|Mg|Ca|Fe|Zn|Cu|Mn|Hg|Ag|Au|Al|As|"
    r"B|C|N|O|P|S|F|I|b|c|n|o|p|s|\(|\)|\.|=|#|-|\+|\\\\|/|:|~|@|\?|>|"
    r"\*|\$|\%[0-9]{2}|[0-9])"
)
#: Words in generated text that is no answer.
LEAKAGE = ("smiles", "assistant", "user", "molecule", "canonical", "ocr")
#: What a reply may open with besides its prompt, in the order in which it is cut off.
OPENINGS = ("assistant", "Assistant", "user", "User", "User:", "user:", "Assistant:", "assistant:", "OCR:")
#: Lines that only name a speaker.
SPEAKERS = ("assistant", "assistant:", "user", "user:")
#: All Unicode white space, and the separators that count as such beside it; what ends a line.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x) -> Column:
    """Without white space at either end: all of it, not blanks alone."""
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def filled(x) -> Column:
    """Trimmed text, or null if nothing is left."""
    return F.nullif(trimmed(x), F.lit(""))


def without_space(x) -> Column:
    return F.regexp_replace(_c(x), f"{SPACE}+", "")


def collapsed(x) -> Column:
    return F.regexp_replace(trimmed(x), f"{SPACE}+", " ")


def strict_key(x) -> Column:
    """The key of an entity: no white space; null if empty or of several fragments."""
    k = without_space(x)
    return F.when((k != "") & ~F.contains(k, F.lit(".")), k)


def tokens(x, pattern: str = TOKEN) -> Column:
    """Tokens by a pattern; single characters where the pattern doesn't cover the whole text."""
    t = _c(x)
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    return F.when(F.array_join(found, "") == t, found).otherwise(F.filter(F.split(t, ""), lambda c: c != ""))


def bag_overlap(a, b) -> Column:
    """How many tokens two bags share, each as often as the rarer has it."""
    a, b = _c(a), _c(b)
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def edit_similarity(a, b) -> Column:
    """1 - edit distance / the longer length; 1 for two empty texts."""
    a, b = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def count_of(x, part: str) -> Column:
    """How often a short text is in another."""
    t = F.coalesce(_c(x), F.lit(""))
    return ((F.length(t) - F.length(F.replace(t, F.lit(part), F.lit("")))) / len(part)).cast("int")


def ring_imbalance(x) -> Column:
    """Ring marks, a digit or % and two digits, that occur an odd number of times; only a digit right behind % is no mark of its own."""
    t = F.coalesce(_c(x), F.lit(""))
    marks = F.concat(F.regexp_extract_all(t, F.lit(r"(?<!%)\d"), F.lit(0)), F.regexp_extract_all(t, F.lit(r"%\d{2}"), F.lit(0)))
    return F.size(F.filter(F.array_distinct(marks), lambda m: F.size(F.filter(marks, lambda y: y == m)) % 2 == 1))


def structure_penalty(x) -> Column:
    """1000 for nothing; else 2 for white space inside, 4 for each bracket too many, 3 for each odd ring mark, 8 for each word that is no answer, and up to 50 for length."""
    t = trimmed(F.coalesce(_c(x), F.lit("")))
    compact = without_space(t)
    odd = F.abs(count_of(compact, "(") - count_of(compact, ")")) + F.abs(count_of(compact, "[") - count_of(compact, "]"))
    words = sum((F.contains(F.lower(t), F.lit(w)).cast("int") for w in LEAKAGE), F.lit(0))
    over = F.greatest(F.lit(0), F.least(F.lit(50), F.floor((F.length(compact) - 256) / 16)))
    return F.when(t == "", F.lit(1000)).otherwise(F.when(compact != t, 2).otherwise(0) + odd * 4 + ring_imbalance(compact) * 3 + words * 8 + over).cast("int")


def clean_prediction(x, prompt: str = "") -> Column:
    """The last line that doesn't only name a speaker, the last of all if there is none, after the prompt and the openings of a reply are cut off."""
    out = trimmed(F.coalesce(_c(x), F.lit("")))
    asked = (prompt, f"User:{prompt}", f"User: {prompt}", f"user:{prompt}", f"user: {prompt}") if prompt else ()
    cut = lambda t, o: F.when(F.startswith(t, o), trimmed(F.substring(t, F.length(o) + 1, F.length(t)))).otherwise(t)
    out = F.aggregate(F.array(*map(F.lit, (*asked, *OPENINGS))), out, cut)
    lines = F.filter(F.transform(F.split(out, LINE_ENDS), trimmed), lambda s: s != "")
    said = F.filter(lines, lambda s: ~F.lower(s).isin(*SPEAKERS))
    return F.coalesce(F.try_element_at(said, F.lit(-1)), F.try_element_at(lines, F.lit(-1)), F.lit(""))


def slug(x) -> Column:
    """Letters, digits, dots and dashes; other runs become an underscore, none at either end."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")


def basename(x) -> Column:
    return F.lower(F.substring_index(F.replace(_c(x), F.lit("\\"), F.lit("/")), "/", -1))


def reason_head(x) -> Column:
    """What stands before the first colon."""
    return F.substring_index(_c(x), ":", 1)


def poly_seed(x) -> Column:
    """The sum of place x code point."""
    chars = F.filter(F.split(_c(x), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, lambda c, i: (i + 1).cast("long") * F.ascii(c)), F.lit(0).cast("long"), lambda s, v: s + v)


def lexical_issues(x) -> Column:
    """What a quick look finds wrong with a molecular string, in a fixed order: empty, multi_fragment, unsupported_character, unbalanced_delimiter."""
    t = without_space(F.coalesce(_c(x), F.lit("")))
    found = (
        (t == "", "empty"),
        (F.contains(t, F.lit(".")), "multi_fragment"),
        (~t.rlike(r"^[A-Za-z0-9@+\-\[\]()=#%\\/.]+$"), "unsupported_character"),
        ((count_of(t, "(") != count_of(t, ")")) | (count_of(t, "[") != count_of(t, "]")), "unbalanced_delimiter"),
    )
    return F.filter(F.array(*[F.when(wrong, F.lit(name)) for wrong, name in found]), lambda i: i.isNotNull())


def lexical_valid(x) -> Column:
    """Whether a quick look finds nothing wrong with a molecular string."""
    return F.size(lexical_issues(x)) == 0


def as_bool(x) -> Column:
    return F.lower(trimmed(x)).isin("1", "true", "yes", "y", "on")
