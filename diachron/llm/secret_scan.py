"""Secret scan: fixed patterns plus sliding-window entropy (DataFrame functions only).

Base kinds are matched leftmost and non-overlapping with the patterns below; matches that fail
their length rule are dropped. The method then looks at candidate strings, maximal runs of one
character class, and slides a window of fixed length over each. The window's character counts
are kept incrementally, as one letter per count in a short string of which each step overwrites two
places: one count goes up, one goes down, and the sum of c*log2(c) moves by the difference, so
Shannon entropy costs the same for every step. Windows at or above the class's threshold merge into
spans. Candidates that an allow-list pattern matches as a whole are suppressed, and so are spans with
an allowed word in them or close by, and spans that lie inside a base span.

Positions are code points, ends exclusive. They come from the lengths of the pieces between
matches, so no engine-specific offset is used.

Defined results: null text counts as empty and has no spans; very long texts are scanned whole;
rows are independent, so repeated rows get equal spans; ties in start are ordered by kind as listed;
an empty table gives an empty result; only the two named columns are read. :func:`secret_spans` adds
``__base`` and ``__spans`` and replaces columns of these names; :func:`redact` keeps all columns as
they are, whatever their names.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and their kinds, in listed order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed", "entropy_lower", "entropy_upper")

#: Per class: kind, characters, candidate pattern, window, least entropy in bits, cheap test that a candidate must pass.
CLASSES = (
    ("entropy_hex", "0123456789abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])", 24, 2.9, r"^(?=.*[0-9])(?=.*[A-Fa-f])"),
    ("entropy_mixed", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", r"[A-Za-z0-9+/_=-]{24,}", 20, 3.6, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"),
    ("entropy_lower", "abcdefghijklmnopqrstuvwxyz0123456789", r"(?<![0-9A-Za-z])[a-z0-9]{24,}(?![0-9A-Za-z])", 24, 3.7, r"^(?=(.*[0-9]){3})(?=.*[g-z])"),
    ("entropy_upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", r"(?<![0-9A-Za-z])[A-Z0-9]{24,}(?![0-9A-Za-z])", 24, 3.7, r"^(?=(.*[0-9]){3})(?=.*[G-Z])"),
)
#: Candidates that these match are not secrets: UUIDs, paths and one repeated character. Possessive, as a
#: repeated group that can be given back takes a stack frame for each repeat, and a path may be of any length.
ALLOW = (
    r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$",
    r"^(.)\1+$",
    r"^[A-Za-z]*+(?:/[A-Za-z_-]++){2,}+$",
)
#: Placeholders: spans with one of these in them or up to ``NEAR`` characters of the same candidate away are not secrets.
ALLOW_WORDS = r"(?i)(example|placeholder|changeme|lorem|dummy|x{8,})"
NEAR = 8
_SPAN = "array<struct<start:int,stop:int,rank:int,kind:string>>"


def _matches(text: Column, pattern: str, kind: str, good) -> Column:
    """Spans of all matches whose text passes ``good``; positions add up the pieces around them."""
    rank = KINDS.index(kind)
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    walked = F.aggregate(
        F.arrays_zip(hits.alias("hit"), F.slice(gaps, 1, F.size(hits)).alias("gap")),
        F.struct(F.lit(0).alias("pos"), F.array().cast(_SPAN).alias("out")),
        lambda s, x: F.struct(
            (s["pos"] + F.length(x["gap"]) + F.length(x["hit"])).alias("pos"),
            F.when(
                good(x["hit"]),
                F.concat(s["out"], F.array(F.struct((s["pos"] + F.length(x["gap"])).alias("start"), (s["pos"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))),
            ).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    return walked.cast(_SPAN)


def _entropy_spans(candidate: Column, alphabet: str, window: int, least: float) -> Column:
    """``array<struct<start,stop>>`` within one candidate: merged windows whose entropy is high enough."""
    gain = [0.0] + [(c + 1) * math.log2(c + 1) - c * math.log2(c) if c else 0.0 for c in range(window)] + [0.0]  # f(c+1)-f(c)
    step = F.array(*[F.lit(x) for x in gain[1:]])  # step[c] = change of the sum when a count goes from c to c+1
    inner = "array<struct<start:int,stop:int>>"
    size, zero_count = len(alphabet), "a"  # a count is held as the letter that many places after a
    place = lambda i: F.instr(F.lit(alphabet), F.substring(candidate, i + 1, 1))
    held = lambda counts, at: F.ascii(F.substring(counts, at, 1)) - ord(zero_count)
    put = lambda counts, at, n: F.overlay(counts, F.char(n + ord(zero_count)), at, 1)

    def move(s, i):
        entering, full = place(i), i >= window
        leaving = place(F.greatest(i - window, F.lit(0)))
        more = held(s["counts"], entering)
        entered = put(s["counts"], entering, more + 1)
        less = held(entered, leaving)
        counts = F.when(full, put(entered, leaving, less - 1)).otherwise(entered)
        total = s["sum"] + F.element_at(step, more + 1) - F.when(full, F.element_at(step, F.greatest(less, F.lit(1)))).otherwise(F.lit(0.0))
        high = (i >= window - 1) & (F.lit(math.log2(window)) - total / window >= least)
        start = (i - window + 1).cast("int")
        grown = (
            F.when(~high, s["out"])
            .when((F.size(s["out"]) > 0) & (F.get(s["out"], F.size(s["out"]) - 1)["stop"] >= start), F.concat(F.slice(s["out"], 1, F.greatest(F.size(s["out"]) - 1, F.lit(0))), F.array(F.struct(F.get(s["out"], F.size(s["out"]) - 1)["start"].alias("start"), (i + 1).cast("int").alias("stop")))))
            .otherwise(F.concat(s["out"], F.array(F.struct(start.alias("start"), (i + 1).cast("int").alias("stop")))))
        )
        return F.struct(counts.alias("counts"), total.alias("sum"), grown.cast(inner).alias("out"))

    zero = F.struct(F.lit(zero_count * size).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(inner).alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.length(candidate) - 1), zero, move, lambda s: s["out"])


def _entropy(text: Column, spec: tuple, allow: tuple, words: str) -> Column:
    kind, alphabet, pattern, window, least, must = spec
    suspicious = lambda c: c.rlike(must) & ~_any(c, allow)
    found = _matches(text, pattern, kind, suspicious)

    def within(m: Column) -> Column:
        run = F.substring(text, m["start"] + 1, m["stop"] - m["start"])
        around = lambda e: F.substring(run, F.greatest(e["start"] - NEAR, F.lit(0)) + 1, e["stop"] - F.greatest(e["start"] - NEAR, F.lit(0)) + NEAR)
        spans = F.filter(_entropy_spans(run, alphabet, window, least), lambda e: ~around(e).rlike(words))
        return F.transform(spans, lambda e: F.struct((m["start"] + e["start"]).alias("start"), (m["start"] + e["stop"]).alias("stop"), m["rank"].alias("rank"), m["kind"].alias("kind")))

    return F.flatten(F.transform(found, within)).cast(_SPAN)


def _any(c: Column, patterns: tuple) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def _ordered(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise(a["stop"] - b["stop"]).cast("int"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_spans(docs: DataFrame, text_col: str = "text", allow: tuple = ALLOW, allow_words: str = ALLOW_WORDS, prefix: str = "__") -> DataFrame:
    """All columns of ``docs`` plus ``__base`` and ``__spans`` (arrays of start, stop, rank, kind)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast(_SPAN)
    value = lambda hit: F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8
    base = F.concat(
        F.when(text.rlike(ASSIGN), _matches(text, ASSIGN, "assign", value)).otherwise(none),
        F.when(text.contains("AKIA"), _matches(text, ACCESS, "access", lambda h: F.length(h) >= 16)).otherwise(none),
        # runs shorter than the rule are dropped either way, and no run overlaps another, so they need not be listed
        F.when(text.rlike(r"[0-9a-f]{32}"), _matches(text, r"(?<![0-9a-f])[0-9a-f]{32,}", "hex", lambda h: F.length(h) >= 32)).otherwise(none),
    )
    entropy = [F.when(text.rlike(spec[2]), _entropy(text, spec, allow, allow_words)).otherwise(none) for spec in CLASSES]
    names = [f"{prefix}{n}" for n in ("base", "more", "spans")]
    known, more, _ = (F.col(f"`{n}`") for n in names)
    out = docs.withColumn(names[0], _ordered(base)).withColumn(names[1], F.concat(*entropy))
    inside = lambda e: F.exists(known, lambda b: (b["start"] <= e["start"]) & (e["stop"] <= b["stop"]))
    both = _ordered(F.concat(known, F.filter(more, lambda e: ~inside(e))))
    return out.withColumn(names[2], F.when((F.size(more) == 0), known).otherwise(both)).drop(names[1])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; every span found, overlapping ones merged, is replaced by ``mark``."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    found = secret_spans(docs, text_col, prefix=prefix)
    text, spans = F.col(text_col), F.col(f"`{prefix}spans`")
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda s, x: F.struct(
            F.greatest(s["pos"], x["stop"]).alias("pos"),
            F.when(x["start"] >= s["pos"], F.concat(s["out"], F.substring(text, s["pos"] + 1, x["start"] - s["pos"]), F.lit(mark))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.concat(s["out"], F.substring(text, s["pos"] + 1, F.length(text))),
    )
    return found.withColumn(text_col, F.when(F.size(spans) == 0, text).otherwise(cut)).select(*[F.col(f"`{c}`") for c in docs.columns])
