"""Column expressions over text: tokens, sentences, lengths, ages. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{IsLatin}\p{N}_]{2,}|[぀-ヿ一-鿿]+"
CJK_RUN = r"^[぀-ヿ一-鿿]"
SENTENCE_END = r"(?<=[。！？.!?])\s+"
EDGE_SPACE = r"^\s+|\s+$"
ENTITY = r"(?:^|[^\p{L}\p{N}_])(\p{Lu}\p{Ll}{2,}(?: +\p{Lu}\p{Ll}+)*)"


def as_ts(value) -> Column:
    return value if isinstance(value, Column) else F.lit(str(value)).cast("timestamp")


def token_estimate(text: Column) -> Column:
    """At least one token, else a third of the characters."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 3)).cast("long")


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def whole_days(later: Column, earlier: Column) -> Column:
    """Floor of the elapsed time in days (not a calendar difference)."""
    return F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400000000.0)).cast("long")


def frac_days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400000000.0)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACE, "")


def space_words(text: Column) -> Column:
    """Lower-case pieces between white space, empties dropped."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def word_list(text: Column, min_len: int = 1) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    return words if min_len <= 1 else F.filter(words, lambda w: F.length(w) >= min_len)


def word_set(text: Column, min_len: int = 1) -> Column:
    return F.array_distinct(word_list(text, min_len))


def search_tokens(text: Column) -> Column:
    """Latin words of two or more characters, and overlapping character pairs of CJK runs.

    Texts without CJK letters, found by one search, skip the per-token step.
    """
    runs = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    pairs = F.flatten(
        F.transform(
            runs,
            lambda r: F.when(
                r.rlike(CJK_RUN) & (F.length(r) > 1),
                F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))),
            ).otherwise(F.array(r)),
        )
    )
    return F.when(text.rlike("[぀-ヿ一-鿿]"), pairs).otherwise(runs)


def sentence_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), strip), lambda s: s != "")


def entity_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def count_true(*flags: Column) -> Column:
    total = F.lit(0)
    for flag in flags:
        total = total + F.coalesce(flag.cast("int"), F.lit(0))
    return total


def label(*cases: tuple[Column, str], default: str | None = None) -> Column:
    """First matching condition names the row."""
    expr = None
    for cond, name in cases:
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def pick(values: list, index: Column) -> Column:
    """Element of a fixed list by zero-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def padded(text: Column) -> Column:
    """Words joined by single spaces with a space at both ends: whole-word phrase search by ``contains``."""
    return F.concat(F.lit(" "), F.array_join(word_list(text), " "), F.lit(" "))


def has_phrase(pad: Column, phrases) -> Column:
    """True if any phrase occurs as whole words in a ``padded`` text."""
    found = F.lit(False)
    for p in phrases:
        found = found | pad.contains(f" {p} ")
    return found


def contains_any(text: Column, parts) -> Column:
    found = F.lit(False)
    for p in parts:
        found = found | text.contains(p)
    return found


def day_text(d: Column) -> Column:
    return F.date_format(d, "d MMMM yyyy")


def stem(token: Column, irregular: dict[str, str] | None = None) -> Column:
    """Suffix stemmer; first rule wins."""
    n = F.length(token)

    def cut(k, add=""):
        base = F.substring(token, F.lit(1), n - k)
        return F.concat(base, F.lit(add)) if add else base

    ing = F.when(cut(3).endswith("k"), cut(3, "e")).otherwise(cut(3))
    rules = (
        F.when((n > 6) & token.endswith("ations"), cut(6))
        .when((n > 5) & token.endswith("ation"), cut(5))
        .when((n > 5) & token.endswith("ies"), cut(3, "y"))
        .when((n > 5) & token.endswith("ing"), ing)
        .when((n > 4) & token.endswith("ied"), cut(3, "y"))
        .when((n > 4) & (token.endswith("ed") | token.endswith("es")), cut(2))
        .when((n > 3) & token.endswith("s"), cut(1))
        .otherwise(token)
    )
    if not irregular:
        return rules
    pairs = F.create_map(*[F.lit(x) for kv in irregular.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, token), rules)


def words_like(text: Column, stems: set[str], irregular: dict[str, str], also: set[str] = frozenset()) -> Column:
    """The words of a text that may have one of the ``stems``, and those of ``also``, in order; no word is stemmed for this.

    ``stem`` cuts an ending and adds at most one letter, and leaves two letters before that, so a word begins as its stem does.
    """
    heads = {s[: {1: 1, 2: 2, 3: 2, 4: 3}.get(len(s), 4)] for s in stems if s}
    whole = sorted({w for w, s in irregular.items() if s in stems} | set(also))

    def like(w: Column) -> Column:
        tests = [w.isin(whole)] if whole else []
        tests += [F.substring(w, 1, n).isin(sorted(h for h in heads if len(h) == n)) for n in sorted({len(h) for h in heads})]
        found = F.lit(False)
        for t in tests:
            found = found | t
        return found

    return F.array_sort(F.filter(word_set(text), like))


def which(flags: dict[str, Column]) -> Column:
    """The names of the conditions that hold."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()])) if flags else F.lit("")
