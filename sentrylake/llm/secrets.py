"""Secret scan: fixed patterns, and sliding-window Shannon entropy over candidate strings. DataFrame functions only.

Candidates are runs of at least WINDOW characters of the base64 alphabets with both letters and digits. Each belongs to a
class, hexadecimal or base64, with an alphabet and a threshold. A window slides over the candidate: the character that comes
in and the one that goes out change two counts, and with them the sum of count * log2(count), from which the entropy follows;
nothing is counted anew. A candidate whose best window reaches its class's threshold is a secret, unless the allow-list knows
it or a pattern has found it already.
"""

from collections.abc import Callable
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of their listing, pattern, capture that must be long enough, and its least length.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{WINDOW},}}+"
#: Class, test, alphabet (of the lower-cased text for hex), least entropy in bits.
CLASSES = [
    ("entropy_hex", r"\A[0-9A-Fa-f]+\z", "0123456789abcdef", 3.0),
    ("entropy_base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", 3.8),
]
#: Strings that look random but are known: placeholders, dates and versions; and words, names and paths, which are letters with
#: single separators and four digits at most at their end. No pattern repeats a group: the matcher would recurse through it.
KNOWN = r"(?i)example|placeholder|changeme|dummy|x{6}|0{8}|12345678|abcdefgh"
NUMBERS = r"\A[0-9/_+-]++\z"
NAMES, PARTED = r"\A[A-Za-z][A-Za-z+/_-]*+[0-9]{0,4}\z", r"[+/_-]{2}"
#: Counts of a window are kept as one character each, this one for none.
NONE = ord("A")


def _span(start: Column, end: Column, order: int, kind: str) -> Column:
    return F.struct(start.cast("int").alias("start"), F.lit(order).alias("order"), end.cast("int").alias("end"), F.lit(kind).alias("kind"))


def _none() -> Column:
    return F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>")


def _let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, which is worked out once however often body reads it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def before(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array's values, merge over zero and all values in front of it. An array can't grow in place, so the values
    are taken in blocks of about the root of their number: n values cost n ** 1.5 copies."""
    none = F.array(zero)

    def along(own: Column, start: Column) -> Column:
        first = F.struct(start.alias("now"), F.filter(none, lambda _: F.lit(False)).alias("out"))
        return F.aggregate(own, first, lambda s, x: F.struct(merge(s["now"], x).alias("now"), F.concat(s["out"], F.array(s["now"])).alias("out")), lambda s: s["out"])

    def blocks(all_values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_values))).cast("int")
        return _let(width, lambda w: F.transform(F.sequence(F.lit(1), F.size(all_values), w), lambda at: F.slice(all_values, at, w)))

    def run(parts: Column) -> Column:
        totals = F.transform(parts, lambda own: F.aggregate(own, zero, merge))
        return F.flatten(F.zip_with(parts, along(totals, zero), along))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(blocks(v), run)).otherwise(F.filter(none, lambda _: F.lit(False))))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost matches that don't overlap; value is the group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), values.alias("value"))
    sized = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), x["value"].alias("value")))

    def placed(x: Column, at: Column) -> Column:
        start = at + x["gap"]
        return F.struct(start.alias("start"), (start + x["hit"]).alias("end"), x["value"].alias("value"))

    return _let(sized, lambda own: F.zip_with(own, before(F.transform(own, lambda x: x["gap"] + x["hit"]), F.lit(0), lambda s, x: s + x), placed))


def _weight(n: Column) -> Column:
    return n * F.log2(F.greatest(n, F.lit(1)).cast("double"))


def best_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest entropy, in bits a character, of the windows over value, which has window characters or more."""
    codes = F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(alphabet)))
    start = F.struct(F.lit(chr(NONE) * len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def held(counts: Column, code: Column) -> Column:
        return F.ascii(F.substr(counts, code, F.lit(1))) - NONE

    def changed(counts: Column, code: Column, by: int) -> Column:
        return F.overlay(counts, F.char(held(counts, code) + NONE + by), code, F.lit(1))

    def run(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            comes = F.element_at(codes, i)
            n = held(state["counts"], comes)
            into = F.struct(changed(state["counts"], comes, 1).alias("counts"), (state["sum"] + _weight(n + 1) - _weight(n)).alias("sum"))

            def out(s: Column) -> Column:
                goes = F.element_at(codes, i - window)
                left = held(s["counts"], goes)
                return F.struct(changed(s["counts"], goes, -1).alias("counts"), (s["sum"] + _weight(left - 1) - _weight(left)).alias("sum"))

            now = _let(into, lambda s: F.when(i > window, out(s)).otherwise(s))
            best = lambda s: F.when(i >= window, F.greatest(state["best"], F.lit(log2(window)) - s["sum"] / window)).otherwise(state["best"])
            return _let(now, lambda s: F.struct(s["counts"].alias("counts"), s["sum"].alias("sum"), best(s).alias("best")))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), start, step, lambda s: s["best"])

    return _let(codes, run)


def _of_kind(found: Column, order: int, kind: str, least: int) -> Column:
    return F.transform(F.filter(found, lambda m: F.length(m["value"]) >= least), lambda m: _span(m["start"], m["end"], order, kind))


def base_spans(text: Column) -> Column:
    parts = []
    for order, (kind, pattern, group, least) in enumerate(PATTERNS):
        parts.append(F.when(text.rlike(pattern), _of_kind(located(text, pattern, group), order, kind, least)).otherwise(_none()))
    return F.array_sort(F.concat(*parts))


def allowed(value: Column) -> Column:
    return value.rlike(KNOWN) | value.rlike(NUMBERS) | (value.rlike(NAMES) & ~value.rlike(PARTED))


def apart(found: Column, known: Column) -> Column:
    """Those of found, which don't overlap each other, that overlap none of known; both by start. Of known spans that start
    before a place only the furthest end counts, so both lists are walked once, not each against each."""
    both = F.array_sort(F.concat(F.transform(known, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("new"), b["end"].alias("end"), F.lit(None).cast("string").alias("value"))), F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("new"), m["end"].alias("end"), m["value"].alias("value")))))
    ends = lambda own: before(F.transform(own, lambda x: F.when(x["new"] == 0, x["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    starts = lambda own: F.reverse(before(F.reverse(F.transform(own, lambda x: F.when(x["new"] == 0, x["start"]).otherwise(2**31 - 1))), F.lit(2**31 - 1), lambda a, b: F.least(a, b)))

    def kept(own: Column) -> Column:
        marked = F.arrays_zip(own.alias("x"), ends(own).alias("reach"), starts(own).alias("next"))
        return F.transform(F.filter(marked, lambda m: (m["x"]["new"] == 1) & (m["reach"] <= m["x"]["start"]) & (m["next"] >= m["x"]["end"])), lambda m: m["x"])

    return F.when(F.size(known) == 0, F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(1).alias("new"), m["end"].alias("end"), m["value"].alias("value")))).otherwise(_let(both, kept))


def entropy_spans(text: Column, known: Column) -> Column:
    """Spans of random-looking strings that overlap no span of known."""
    found = F.filter(located(text, CANDIDATE), lambda m: m["value"].rlike("[0-9]") & m["value"].rlike("[A-Za-z]") & ~allowed(m["value"]))
    (hex_kind, hex_test, hex_letters, hex_least), (base_kind, _, base_letters, base_least) = CLASSES

    def judged(m: Column) -> Column:
        is_hex = m["value"].rlike(hex_test)
        hit = F.when(is_hex, best_entropy(F.lower(m["value"]), hex_letters) >= hex_least).otherwise(best_entropy(m["value"], base_letters) >= base_least)
        return F.when(hit, F.when(is_hex, _span(m["start"], m["end"], len(PATTERNS), hex_kind)).otherwise(_span(m["start"], m["end"], len(PATTERNS) + 1, base_kind)))

    return F.when(text.rlike(CANDIDATE), F.array_compact(F.transform(apart(found, known), judged))).otherwise(_none())


def listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with base and found: the spans of the patterns, and those of patterns and entropy together, as arrays of (start,
    order, end, kind) by start and then kind; places are code points, ends exclusive.

    A null text counts as empty; both have no spans. Texts are scanned whole. Rows that repeat get equal spans; other columns
    are carried, those named base or found are replaced. No shuffle, no Python.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.withColumn("base", base_spans(text)).withColumn("found", F.array_sort(F.concat("base", entropy_spans(text, F.col("base")))))
