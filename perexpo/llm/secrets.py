"""Secrets in texts: patterns, and strings of high entropy.

Base spans come from three patterns, leftmost and non-overlapping per kind. The scan adds
spans of kind ``entropy``: candidate strings in which the Shannon entropy of some sliding
window of ``WINDOW`` characters reaches the threshold of the string's character class. The
window moves by one character at a time and only the two counts that change are looked at.
Candidates on the allow list, and those that overlap a base span, add nothing.

Only built-in functions are used. Offsets are code points, ends are exclusive. Positions
come from the lengths of the pieces between the matches, so a text is scanned once to see
whether a pattern occurs, and again only if it does.

Defined cases: null and empty texts have no spans. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns: kind, pattern, the group whose length counts, its smallest length. A run
#: of hex digits and a key id are matched with their smallest length at once, which finds
#: the same spans, because a run that is too short holds no longer one.
BASE = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ENTROPY = "entropy"
KINDS = (*(kind for kind, *_ in BASE), ENTROPY)

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALL = f"{_UPPER}{_LOWER}{_DIGITS}+/_=-"
#: Character class: pattern that the whole string must match, its symbols, bits per symbol; the first that matches counts.
#: A window of random symbols has 3.85 bits on average if there are 36 of them, 3.79 if 32 (base32), and
#: 4.03 if 62 or 64. The thresholds of these classes lie near the lowest hundredth of such windows. Strings with
#: signs that lack upper case, lower case or digits are mostly paths and titles, and have to reach more.
CLASSES = (
    (r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 3.0),
    (r"^[a-z0-9]+$", f"{_LOWER}{_DIGITS}", 3.3),
    (r"^[A-Z0-9]+$", f"{_UPPER}{_DIGITS}", 3.3),
    (r"^[A-Za-z0-9]+$", f"{_UPPER}{_LOWER}{_DIGITS}", 3.6),
    (r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+/_=-]+$", _ALL, 3.6),
    (r"^[A-Za-z0-9+/_=-]+$", _ALL, 3.9),
)
#: Strings that are no secrets: one alphabet only, hyphenated words, paths, ids with a fixed
#: layout, placeholders.
ALLOWED = (
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[^0-9]+$",
    # Possessive, so that the matcher goes on in a loop: each repeat of a plain group takes a frame of its stack.
    r"^[A-Za-z]++(?:[-_/=+][A-Za-z]++)*+[-_/=+]?$",
    r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"(?i)example|sample|placeholder|dummy|xxxx|0000000|1234567",
)
_SPANS = "array<struct<start:int,end:int,kind:int>>"
#: Spans that are added up together.
_BLOCK = 256


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that it uses several times, worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """The items in blocks: an array that grows by one is copied each time, so what grows are small arrays."""
    last = F.floor((F.size(items) - 1) / _BLOCK).cast("int")
    # A sequence to -1 would run backwards.
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: k <= last)
    return F.transform(numbers, lambda k: F.slice(items, k * _BLOCK + 1, F.lit(_BLOCK)))


def _running(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], shape: str) -> Column:
    """What ``step`` gives for each item, from the state before it; ``step`` gives the next state too."""
    none = F.array().cast(f"array<{shape}>")

    def one(state: Column, item: Column) -> Column:
        after, out = step(state["at"], item)
        return F.struct(after.alias("at"), F.concat(state["out"], F.array(out.cast(shape))).alias("out"))

    def block(state: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(state["at"].alias("at"), none.alias("out")), one)
        return _once(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], i["out"]).alias("out")))

    begun = F.struct(start.alias("at"), none.alias("out"))
    return _once(items, lambda own: F.aggregate(_blocks(own), begun, block, lambda s: s["out"]))


def _matches(text: Column, pattern: str, groups: tuple[int, ...]) -> Column:
    """Array of (start, end, group...) of all matches."""
    rule = F.lit(pattern)
    lengths = F.transform(F.split(text, pattern, -1), F.length)
    found = [F.regexp_extract_all(text, rule, F.lit(g)) for g in groups]
    hits = F.transform(F.regexp_extract_all(text, rule, F.lit(0)), F.length)
    shape = f"struct<start:int,end:int,{','.join(f'g{g}:string' for g in groups)}>"

    def step(at: Column, both: Column) -> tuple[Column, Column]:
        start = at + both["gap"]
        end = start + both["hit"]
        return end, F.struct(start.alias("start"), end.alias("end"), *[both[f"g{g}"].alias(f"g{g}") for g in groups])

    gap = F.slice(lengths, F.lit(1), F.size(hits))
    zipped = F.arrays_zip(gap.alias("gap"), hits.alias("hit"), *[f.alias(f"g{g}") for f, g in zip(found, groups, strict=True)])
    walked = _running(zipped, F.lit(0), step, shape)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{shape}>"))


def base_spans(text: Column) -> Column:
    """Array of (start, end, kind number) of the three patterns, not yet in order."""
    def spans(number: int, pattern: str, group: int, least: int) -> Column:
        long_enough = F.filter(_matches(text, pattern, (group,)), lambda m: F.length(m[f"g{group}"]) >= least)
        return F.transform(
            long_enough,
            lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(number).alias("kind")),
        )

    return F.concat(*[spans(number, *rule) for number, (_, *rule) in enumerate(BASE)])


def window_entropy(value: Column, symbols: str, window: int = WINDOW, enough: float = math.inf) -> Column:
    """Largest Shannon entropy, in bits per symbol, of the windows of a string, or the first that is ``enough``.

    With counts n of a window of w symbols the entropy is log2(w) - sum(n * log2(n)) / w. A
    move changes the count of the symbol that leaves and of the one that enters, and the sum
    by the terms of these two. A string shorter than the window is one window.
    """
    terms = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(window + 1)])
    width = F.least(F.length(value), F.lit(window))
    # Cut once: a character by its number would be counted out from the start each time.
    symbol = F.transform(F.split(value, ""), lambda c: F.when(c != "", F.position(c, F.lit(symbols))).otherwise(F.lit(0)))

    def move(symbols_of: Column, state: Column, i: Column) -> Column:
        counts = state["counts"]
        enters, leaves = F.get(symbols_of, i - 1), F.get(symbols_of, i - 1 - window)
        fewer = F.get(counts, leaves)
        more = F.get(counts, enters) - F.when(enters == leaves, 1).otherwise(0)
        total = (
            state["total"]
            - F.coalesce(F.get(terms, fewer) - F.get(terms, fewer - 1), F.lit(0.0))
            + F.get(terms, more + 1)
            - F.get(terms, more)
        )
        entropy = F.log2(width) - total / width
        moved = F.struct(
            F.transform(
                counts,
                lambda n, k: n + F.when(k == enters, 1).otherwise(0) - F.when(k == leaves, 1).otherwise(0),
            ).alias("counts"),
            total.alias("total"),
            F.when(i >= width, F.greatest(state["best"], entropy)).otherwise(state["best"]).alias("best"),
        )
        return moved if enough == math.inf else F.when(state["best"] >= enough, state).otherwise(moved)

    start = F.struct(
        F.array_repeat(F.lit(0), len(symbols) + 1).alias("counts"),
        F.lit(0.0).alias("total"),
        F.lit(0.0).alias("best"),
    )

    def walk(symbols_of: Column) -> Column:
        # The symbols stay outside the state, which is copied at every step.
        steps = F.sequence(F.lit(1), F.length(value))
        return F.aggregate(steps, start, lambda state, i: move(symbols_of, state, i), lambda state: state["best"])

    walked = _once(symbol, walk)
    return F.when(F.length(value) > 0, walked).otherwise(F.lit(0.0))


def is_random(value: Column) -> Column:
    """Whether the entropy of a candidate reaches the threshold of its class, and no rule allows it."""
    reached = F.lit(False)
    for pattern, symbols, bits in reversed(CLASSES):
        reached = F.when(value.rlike(pattern), window_entropy(value, symbols, enough=bits) >= bits).otherwise(reached)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(reached)


_MARKED = "struct<start:int,end:int,base:boolean,free:boolean,g0:string>"


def _apart(found: Column, base: Column) -> Column:
    """Those of ``found``, which do not overlap each other, that overlap none of ``base``.

    One walk over all spans by start meets the base spans before a candidate, one from the other end those after it.
    """

    def marked(m: Column, is_base: Column, free: Column, value: Column) -> Column:
        fields = {"start": m["start"], "end": m["end"], "base": is_base, "free": free, "g0": value}
        return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(_MARKED)

    def forward(reach: Column, m: Column) -> tuple[Column, Column]:
        after = F.when(m["base"], F.greatest(reach, m["end"])).otherwise(reach)
        return after, marked(m, m["base"], ~m["base"] & (reach <= m["start"]), m["g0"])

    def backward(next_start: Column, m: Column) -> tuple[Column, Column]:
        after = F.when(m["base"], F.least(next_start, m["start"])).otherwise(next_start)
        return after, marked(m, m["base"], m["free"] & (next_start >= m["end"]), m["g0"])

    candidates = F.transform(found, lambda m: marked(m, F.lit(False), F.lit(True), m["g0"]))
    bases = F.transform(base, lambda m: marked(m, F.lit(True), F.lit(False), F.lit("")))
    # Ties of start and end do not matter: such spans overlap.
    first = _running(F.array_sort(F.concat(candidates, bases)), F.lit(0), forward, _MARKED)
    last = _running(F.reverse(first), F.lit(2**31 - 1), backward, _MARKED)
    near = F.reverse(F.filter(last, lambda m: m["free"]))
    return F.when(F.size(base) > 0, near).otherwise(candidates)


def entropy_spans(text: Column, base: Column) -> Column:
    """Array of (start, end, kind number) of the random strings outside the base spans."""
    kind = len(BASE)
    def random_of(found: Column) -> Column:
        return F.filter(_apart(found, base), lambda m: is_random(m["g0"]))

    random = _once(_matches(text, CANDIDATE, (0,)), random_of)
    return F.transform(
        random, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def scan(docs: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "spans") -> DataFrame:
    """All columns of ``docs`` and two arrays of (start, end, kind) in order: base spans, all spans.

    Columns of ``docs`` with these two names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))

    def both(own: Column) -> Column:
        every = F.array_sort(F.concat(own, entropy_spans(value, own)))
        return F.struct(F.transform(own, _named).alias("base"), F.transform(every, _named).alias("every"))

    found = _once(F.sort_array(base_spans(value).cast(_SPANS)), both)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (base, spans)]
    return docs.select(*rest, found.alias("_found")).select(
        *rest, F.col("_found.base").alias(base), F.col("_found.every").alias(spans)
    )


def _named(span: Column) -> Column:
    kind = F.get(F.array(*map(F.lit, KINDS)), span["kind"])
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), kind.alias("kind"))


def as_text(spans: Column) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, or run of overlapping spans, replaced by a mark."""

    none = F.array().cast("array<string>")

    def block(state: Column, part: Column) -> Column:
        """One block of spans, on the piece of text that they lie in."""
        start = state["at"]
        upto = F.greatest(start, F.array_max(F.transform(part, lambda s: s["end"])))

        def cut(piece: Column) -> Column:
            def one(inner: Column, s: Column) -> Column:
                before = F.substring(piece, inner["at"] - start + 1, s["start"] - inner["at"])
                return F.when(
                    s["start"] >= inner["at"],
                    F.struct(s["end"].alias("at"), F.concat(inner["out"], F.array(before, F.lit(mark))).alias("out")),
                ).otherwise(F.struct(F.greatest(s["end"], inner["at"]).alias("at"), inner["out"].alias("out")))

            walked = F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), one)
            return _once(walked, lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], i["out"]).alias("out")))

        return _once(F.substring(text, start + 1, upto - start), cut)

    def rest(own: Column) -> Column:
        return F.aggregate(
            _blocks(own),
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            block,
            lambda s: F.array_join(F.concat(s["out"], F.array(F.substring(text, s["at"] + 1, F.length(text)))), ""),
        )

    return F.when(F.size(spans) > 0, _once(spans, rest)).otherwise(text)
