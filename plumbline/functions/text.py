"""Text expressions: placeholders, tokens, section headers, codes, windows. All run inside the JVM.

Java's regular expressions differ from the ones usual in scripting languages in two ways that matter
here: without the flag ``d`` a line also begins after a carriage return, and without the flag ``U``
``\\s`` is ASCII only. The flags are set where the difference can be seen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The section headers counted by surface features, in the order in which they are tried.
SECTION_HEADERS = (
    "assessment", "plan", "assessment and plan",
    "hospital course", "hospital course by", "summary of hospital course",
    "history of present illness", "hpi",
    "discharge medications", "medications on discharge", "medications at discharge",
    "discharge instructions",
    "pertinent results", "pertinent labs", "pertinent studies",
    "past medical history", "pmh",
    "chief complaint", "cc",
)

_MASKED = r"(?d)\[\*\*.*?\*\*\]"
_SECTION = r"(?mid)^\s*(?:" + "|".join(SECTION_HEADERS) + r")\s*:?"
_COURSE = r"(?mid)^\s*(?:brief\s+hospital\s+course|hospital\s+course|hospital\s+course\s+by.*|summary\s+of\s+hospital\s+course)\s*:?"


def encoder_form(text: Column) -> Column:
    """Placeholders as the word ``unknown``: each bracketed one, and every three underscores."""
    return F.replace(F.regexp_replace(text, _MASKED, "unknown"), F.lit("___"), F.lit("unknown"))


def surface_form(text: Column) -> Column:
    """Placeholders as ``PHI``: each bracketed one, and each run of three or more underscores."""
    return F.regexp_replace(F.regexp_replace(text, _MASKED, "PHI"), "___+", "PHI")


def whitespace_tokens(text: Column) -> Column:
    """Tokens between Unicode white space; none are empty."""
    return F.filter(F.split(text, r"(?U)[\s\x1C-\x1F]+"), lambda x: x != "")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def words(text: Column) -> Column:
    """Runs of three or more ASCII letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{3,}"), F.lit(0))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def section_keys(text: Column, *, collapse: bool = False) -> Column:
    """Distinct normalised section headers. A header has no right boundary: ``Planned`` counts as ``plan``.

    White space is stripped before the closing colon is, so ``assessment :`` keeps its blank and is
    a key of its own, unless ``collapse`` (which also squeezes inner white space) is set.
    """
    found = F.transform(F.regexp_extract_all(text, F.lit(_SECTION), F.lit(0)), lambda m: F.regexp_replace(F.lower(stripped(m)), ":+$", ""))
    return F.array_distinct(F.transform(found, lambda m: F.regexp_replace(m, r"\s+", " ")) if collapse else found)


def has_course(text: Column) -> Column:
    return F.rlike(text, F.lit(_COURSE))


def surface_features(text: Column) -> list[Column]:
    """Length, tokens, distinct sections, and the densities of numbers and placeholders, without a Python function."""
    t = surface_form(text)
    tokens = whitespace_tokens(t)
    n = F.greatest(F.size(tokens), F.lit(1))
    return [
        F.length(t).alias("length"),
        F.size(tokens).alias("n_tokens"),
        F.size(section_keys(t)).alias("n_sections"),
        (F.size(F.filter(tokens, lambda x: F.rlike(x, F.lit(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]")))) / n).alias("numeric_density"),
        (F.regexp_count(t, F.lit(r"(?U)\bPHI\b")) / n).alias("phi_density"),
    ]


def normalised_code(code: Column) -> Column:
    """Stripped, upper-cased, without dots; ``NAN``, ``NONE``, ``NULL`` and the empty string are null; leading zeros stay."""
    c = F.replace(F.upper(stripped(code)), F.lit("."), F.lit(""))
    return F.when(c.isin("NAN", "NONE", "NULL", ""), None).otherwise(c)


def token_windows(tokens: Column, size: int = 510, stride: int = 256) -> Column:
    """Overlapping windows; the last is the first that reaches the end. No tokens, no windows."""
    n = F.size(tokens)
    count = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride))).cast("int")) + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(tokens, i * stride + 1, F.lit(size)))).otherwise(F.array().cast("array<array<string>>"))


def padded(window: Column, size: int, pad: str) -> Column:
    return F.concat(window, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(size) - F.size(window))))


def attention_mask(window: Column, size: int) -> Column:
    """1 for the window's tokens and its two special ones, 0 for the padding up to ``size``."""
    n = F.size(window) + 2
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(size) - n)))


def pooling_mask(window: Column, size: int) -> Column:
    """As the attention mask, but 0 for the special tokens at both ends too."""
    n = F.size(window)
    return F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.greatest(F.lit(1), F.lit(size) - n - 1)))


def masked_mean(vectors: Column, mask: Column, dimensions: int) -> Column:
    """The mean of the vectors whose mask is 1; a mask without any fails the job."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), dimensions), lambda s, v: F.zip_with(s, v, lambda a, b: a + b))
    return F.when(F.size(kept) == 0, F.raise_error(F.lit("a window has no token to pool"))).otherwise(F.transform(total, lambda x: x / F.size(kept)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def spliced(text: Column, start: Column, end: Column, body: Column) -> Column:
    """``text`` with the characters [start, end) replaced; the white space around the old body is kept."""
    old = F.substr(text, start + 1, end - start)
    lead, tail = F.regexp_extract(old, r"(?U)^\s*", 0), F.regexp_extract(old, r"(?U)\s*$", 0)
    return F.concat(F.substr(text, F.lit(1), start), lead, body, tail, F.substr(text, end + 1, F.length(text)))
