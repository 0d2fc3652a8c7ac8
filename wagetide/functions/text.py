"""Text functions as built-in expressions: normalising, tokens, skeletons, phrases, similarity, patterns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .literals import constant, strings

#: Banking words without an employer's name, codes of payment routes, words of pay roles, legal forms.
STOP_WORDS = ("REF", "REFERENCE", "PAYMENT", "CREDIT", "ONLINE", "TRANSFER", "TFR")
CHANNEL_CODES = ("BACS", "BAC", "BGC", "FPI", "FPS", "FP", "CHAPS", "CHP", "CHQ", "CASH", "CDM", "TLR", "STO", "ITL", "IBAN", "SWIFT", "DC", "TFR")
ROLE_WORDS = ("PAYROLL", "SALARY", "WAGE", "WAGES", "PAY", "STAFF", "MONTHLY", "HR", "EMPLOYEE", "EMPLOYER", "CREDIT", "PAYMENT", "DIRECT", "AUTOMATED", "ONLINE")
LEGAL_FORMS = ("LTD", "PLC", "LLP", "LLC", "INC", "GROUP")
EMPTY = "__EMPTY__"


@lru_cache(maxsize=1)
def _folded() -> tuple[str, str, dict[str, str]]:
    """From the Unicode tables: characters that compatibility decomposition without marks turns into one ASCII letter or digit, what
    they become, and those that become several characters of which one is ASCII."""
    one, to, several = [], [], {}
    for cp in range(128, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        d = unicodedata.normalize("NFKD", chr(cp))
        s = "".join(c for c in d if not unicodedata.combining(c))
        if s == chr(cp) or not any(c.isascii() and c.isalnum() for c in s):
            continue
        if len(s) == 1:
            one.append(chr(cp))
            to.append(s)
        else:
            several[chr(cp)] = s
    return "".join(one), "".join(to), several


@lru_cache(maxsize=1)
def _marks() -> str:
    """A pattern for runs of combining marks, those of combining class 0 left out."""
    found = [cp for cp in range(128, sys.maxunicode + 1) if unicodedata.combining(chr(cp))]
    have = set(found)
    heads, ends = [cp for cp in found if cp - 1 not in have], [cp for cp in found if cp + 1 not in have]
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{z:X}}}" for a, z in zip(heads, ends, strict=True)) + "]+"


def unaccented(c: Column) -> Column:
    """Compatibility decomposition without combining marks, as far as letters and digits go. ASCII texts are returned at once."""
    one, to, several = _folded()
    pairs = constant(several, "map<string,string>")
    found = "[" + "".join(several) + "]"
    split = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(found), F.element_at(pairs, x)).otherwise(x)), "")
    wide = F.when(c.rlike(found), split).otherwise(c)
    return F.when(c.rlike(r"^[\x00-\x7F]*$"), c).otherwise(F.regexp_replace(F.translate(wide, one, to), _marks(), ""))


def normalised(c: Column) -> Column:
    x = F.upper(unaccented(F.coalesce(c, F.lit(""))))
    x = F.regexp_replace(x, r"\bPUBLIC LIMITED COMPANY\b", "PLC")
    x = F.regexp_replace(x, r"\bLIMITED\b", "LTD")
    return F.trim(F.regexp_replace(F.regexp_replace(x, "[^A-Z0-9 ]+", " "), " +", " "))


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def among(c: Column, words) -> Column:
    return F.array_contains(strings(dict.fromkeys(words)), c)


def skeleton(toks: Column) -> Column:
    """Tokens without long numbers, stop words and trailing digits; both patterns are fixed values."""
    kept = F.filter(toks, lambda t: ~t.rlike(r"^\d{4,}$") & ~among(t, STOP_WORDS))
    cut = F.transform(kept, lambda t: F.regexp_replace(t, r"(?<=[A-Z])\d{2,}$", ""))
    s = F.array_join(F.filter(cut, lambda t: (t != "") & ~among(t, STOP_WORDS)), " ")
    return F.when(s == "", F.lit(EMPTY)).otherwise(s)


def has_phrase(normal: Column, phrase: str) -> Column:
    """Whether the phrase's words follow each other in the normalised text."""
    return F.concat(F.lit(" "), normal, F.lit(" ")).contains(f" {phrase} ")


def jaccard(a: Column, b: Column) -> Column:
    """Of token sets; none in common with nothing."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays. Only elements that both have can count; mostly what is left is equal, and
    the usual table, row by row, is for the rest."""

    def table(a, b):
        def row(prev, x):
            def cell(s, i):
                here = F.when(x == F.get(b, i), s["diag"] + 1).otherwise(F.greatest(s["left"], F.get(prev, i)))
                return F.struct(F.concat(s["row"], F.array(here)).alias("row"), here.alias("left"), F.get(prev, i).alias("diag"))

            start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("diag"))
            return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), start, cell)["row"]

        return F.array_max(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b)), row))

    both = F.struct(F.filter(a, lambda t: F.array_contains(b, t)).alias("a"), F.filter(b, lambda t: F.array_contains(a, t)).alias("b"))
    found = F.transform(F.array(both), lambda s: F.when(s["a"] == s["b"], F.size(s["a"])).otherwise(table(s["a"], s["b"])))
    return F.get(found, F.lit(0))


def sequence_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.size(a), F.size(b))
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(lcs_length(a, b) / longest)


def blended_similarity(a: Column, b: Column) -> Column:
    return F.round(0.9 * jaccard(a, b) + 0.1 * sequence_ratio(a, b), 6)


def alike(a: Column, b: Column) -> tuple[Column, Column]:
    """jaccard and sequence_ratio of structs of tokens and kinds (different tokens). Where no token repeats and the common ones stand in
    one order, their number is all that counts; only other pairs take the table of subsequences."""
    x, y = a["tokens"], b["tokens"]
    ab, ba = F.array_intersect(x, y), F.array_intersect(y, x)
    longest, plain = F.greatest(F.size(x), F.size(y)), (a["kinds"] == F.size(x)) & (b["kinds"] == F.size(y))
    union = a["kinds"] + b["kinds"] - F.size(ab)
    order = F.when(x == y, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(plain & (ab == ba), F.size(ab) / longest).otherwise(lcs_length(x, y) / longest)
    return F.when(union == 0, 0.0).otherwise(F.size(ab) / union).alias("jaccard"), order.alias("sequence")


def common_prefix(a: Column, b: Column) -> Column:
    """Of two strings."""
    k = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda k: F.left(a, k) == F.left(b, k)))
    return F.left(a, k)


def prefix_of_all(strings: Column) -> Column:
    return F.coalesce(common_prefix(F.array_min(strings), F.array_max(strings)), F.lit(""))


def majority_prefix(strings: Column, support: float) -> Column:
    """The longest prefix that a share of the strings has: such strings stand next to each other once sorted, so the first and the last
    of each run of that many decide."""
    need = F.greatest(F.lit(1), F.bround(F.lit(support) * F.size(strings), 0).cast("int"))
    s = F.array_sort(strings)
    runs = F.sequence(F.lit(0), F.size(s) - need)
    found = F.transform(runs, lambda i: common_prefix(F.get(s, i), F.get(s, i + need - 1)))
    best = F.array_max(F.transform(found, lambda p: F.length(p)))
    return F.get(F.filter(found, lambda p: F.length(p) == best), F.lit(0))


def with_pattern(df: DataFrame, col: str, support: float, least: int) -> DataFrame:
    """df with pattern, a struct of the prefix and suffix that a share of the non-empty strings in the array col has, together at least
    that many characters; else null. Built in steps, so that no step's expression is worked out twice."""
    df = df.withColumn("_s", F.filter(col, lambda x: x.isNotNull() & (x != "")))
    df = df.withColumn("_t", F.transform("_s", lambda x: F.reverse(x)))
    df = df.withColumns({"_p": prefix_of_all(F.col("_s")), "_q": prefix_of_all(F.col("_t"))})
    df = df.withColumn("_short", F.length("_p") + F.length("_q") < least)
    df = df.withColumns({"_p": F.when(F.col("_short"), majority_prefix(F.col("_s"), support)).otherwise(F.col("_p")), "_q": F.when(F.col("_short"), majority_prefix(F.col("_t"), support)).otherwise(F.col("_q"))})
    df = df.withColumn("_f", F.struct(F.col("_p").alias("prefix"), F.reverse("_q").alias("suffix")))
    hits = F.size(F.filter("_s", lambda x: fits(x, F.col("_f"))))
    ok = (F.size("_s") > 0) & (F.length("_p") + F.length("_q") >= least) & (hits / F.size("_s") >= support)
    return df.withColumn("pattern", F.when(ok, F.col("_f"))).drop("_s", "_t", "_p", "_q", "_short", "_f")


def fits(x: Column, found: Column) -> Column:
    return x.startswith(found["prefix"]) & x.endswith(found["suffix"])


def unfenced(reply: Column) -> Column:
    """A reply's JSON without the fence around it."""
    x = F.trim(reply)
    return F.trim(F.when(x.startswith("```"), F.regexp_replace(F.regexp_replace(x, r"^```[^\n]*\n?", ""), r"```$", "")).otherwise(x))


def longest_common_substring(a: str, b: str) -> str:
    """Of two strings, the first in a: extends matches diagonal by diagonal over b's places of each character."""
    places: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        places.setdefault(c, []).append(j)
    best, end, runs = 0, 0, {}
    for i, c in enumerate(a):
        runs = {j: runs.get(j - 1, 0) + 1 for j in places.get(c, ())}
        if runs and (top := max(runs.values())) > best:
            best, end = top, i + 1
    return a[end - best : end]
