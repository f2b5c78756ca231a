"""Personal data: fixed patterns, and further spans chosen by boosted trees.

The fixed patterns give the base spans. Generators of high recall propose more, which
may overlap: loose number runs, tight digit groups, things that look like written-out
addresses. Each proposal is described by yes-or-no features of its format and its
surroundings, packed to a number (its cell). Proposals that overlap a base span are
examples of its kind, with the signs hidden by which its pattern knows it (the plus of a phone,
the notation of an address). Proposals of other kinds are counterexamples, and those that overlap nothing
have no label: some are of the kind and only written differently. Small trees are boosted for each kind on the
counts of all cells of the whole table; no row is sampled or collected, only the counts of the cells (16,384 at most).

The trees learn which proposals a pattern finds. Of the proposals of a kind it finds the
same part c whatever the hidden signs are, and c is what the trees say of examples that they have not
learned from, on average. So their word over c is the probability that a proposal is of the
kind: cells where it is a half or more are redacted, if hardly any example of another kind is among them.

All work on texts is DataFrame functions. A text is cut at a pattern (``split``) and
its matches are listed (``regexp_extract_all``); lengths of the pieces give positions.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tomeseek.llm.common import fold_of, free_name
from tomeseek.session import written

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: The base patterns. A run that can't start a match is passed over once, not tried from each of its places; ``\G`` is where the last match ended.
BASE = {
    EMAIL: rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?[0-9]){13,}+",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The generators: number runs, digit groups, written-out addresses.
PROPOSED = {
    "run": r"(?<![0-9+(])[+(]?[0-9](?:[ ().-]{0,3}[0-9]){5,}+",
    "group": r"(?<![0-9])[0-9]{3,4}+(?:[ ./-]?[0-9]{3,4}){2,4}+(?![0-9])",
    "address": rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}+ ?(?:\(at\)|\[at\]|@) ?[A-Za-z0-9-]{{1,63}}+(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]{{1,63}}+)++",
}
CONTEXT = r"(?i)(?:mail|contact|phone|tel\b|call|fax|mobile|card|visa|credit|account|host|server|addr|\bip\b)"
FEATURES = ("at", "dot", "dash", "space", "plus", "7 digits", "10 digits", "14 digits", "17 digits", "luhn", "context", "glued", "octets", "date")
#: What is hidden from the trees of a kind. Luhn's digit and the octets stay: a number that fails them is none.
HIDDEN = {EMAIL: ("dot", "dash", "space"), IP: ("dash", "space"), CARD: ("dot", "dash", "space"), PHONE: ("plus", "space")}
TREES, RATE = 24, 0.3
#: Least probability of a redacted cell, least part of examples of the kind among labelled ones there, least number of examples to learn from.
PROBABLE = 0.5
PRECISION = 0.97
LEAST = 20

_SPAN = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits, 19 at most, have a right check digit."""
    each = F.regexp_extract_all(F.reverse(_digits(value)), F.lit("[0-9]"), F.lit(0))
    doubled = lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
    total = F.aggregate(F.transform(each, doubled), F.lit(0), lambda a, x: a + x)
    return F.when(F.length(_digits(value)) <= 19, total % 10 == 0).otherwise(False)


def _fine(kind: int, value: Column) -> Column:
    """What a match of a base pattern has to meet."""
    n = F.length(_digits(value))
    return {
        EMAIL: F.lit(True), IP: value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        CARD: n.between(14, 19) & luhn(value), PHONE: n.between(10, 15),
    }[kind]


def _spans(pieces: Column, matches: Column) -> Column:
    """start, end, value and what stands around for each match, from the pieces between matches."""
    n = F.size(matches)
    parts = F.arrays_zip(F.slice(pieces, 1, n).alias("gap"), matches.alias("value"), F.slice(pieces, 2, n).alias("next"))
    made = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            (acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"),
            x["value"].alias("value"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(1)).alias("after")))).alias("out"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(n > 0, F.aggregate(parts, start, made, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _cell(x: Column) -> Column:
    """The features of a proposal, one bit each."""
    value, n = x["value"], F.length(_digits(x["value"]))
    has = lambda sign: F.contains(value, F.lit(sign))
    bits = (
        has("@") | has("at)") | has("at]"), has("."), has("-") | has("("), has(" "), value.startswith("+"), n >= 7, n >= 10, n >= 14, n >= 17, luhn(value),
        x["before"].rlike(CONTEXT), x["before"].rlike(r"[\p{L}0-9]$") | x["after"].rlike(r"[\p{L}0-9]"), value.rlike(rf"^{_PART}(?:[.,] ?{_PART}){{3}}$"),
        value.rlike("^(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]"),
    )
    return reduce(lambda a, b: a + b, (F.when(bit, F.lit(1 << i)).otherwise(F.lit(0)) for i, bit in enumerate(bits)))


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def spans_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text, with base (start, kind, end) in order and proposed (start, end, cell, kind of the base span it overlaps, -1: none).

    Where ``docs`` has such a name, the new column's begins with an underscore.
    """
    base_name, proposed_name = free_name(docs, "base"), free_name(docs, "proposed")
    body = F.coalesce(F.col(text), F.lit(""))
    digit, at = body.rlike("[0-9]"), body.rlike(r"@|\(at\)|\[at\]")
    needs = {EMAIL: F.contains(body, F.lit("@")), IP: digit, CARD: digit, PHONE: F.contains(body, F.lit("+")), "run": digit, "group": digit, "address": at}
    patterns = BASE | PROPOSED
    names = {k: free_name(docs, f"cut_{k}") for k in patterns}
    empty = F.array().cast("array<string>")
    # The pieces and matches are columns of their own: inside a lambda they would be made again for each element.
    cut = docs.withColumns({
        names[k]: F.when(needs[k], F.struct(
            F.split(body, p, -1).alias("pieces"), F.regexp_extract_all(body, F.lit(p), F.lit(0)).alias("matches"),
        )).otherwise(F.struct(empty.alias("pieces"), empty.alias("matches"))) for k, p in patterns.items()})
    spans = {k: _spans(F.col(names[k])["pieces"], F.col(names[k])["matches"]) for k in patterns}

    def of_kind(k: int) -> Column:
        right = F.filter(spans[k], lambda x: _fine(k, x["value"]))
        return F.transform(right, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))

    base = F.array_sort(F.concat(*map(of_kind, BASE)))
    proposed = F.array_distinct(F.concat(*(
        F.transform(spans[k], lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), _cell(x).alias("cell"))) for k in PROPOSED)))
    found = cut.withColumns({base_name: base, proposed_name: proposed}).drop(*names.values(), text)
    # Of base spans that overlap a proposal the first one names its kind.
    labelled = F.transform(proposed_name, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), p["cell"].alias("cell"),
        F.coalesce(F.get(F.transform(F.filter(base_name, lambda b: _overlaps(p, b)), lambda b: b["kind"]), F.lit(0)), F.lit(-1)).alias("kind")))
    return found.withColumn(proposed_name, labelled)


def _margin(trees: list[tuple], cell: int) -> float:
    total = 0.0
    for bias, root, low, high in trees:
        bit, values = high if cell >> root & 1 else low
        total += bias + values[cell >> bit & 1]
    return total


def boost(cells: dict[int, tuple[float, float]]) -> list[tuple]:
    """Trees of depth two for the log odds of a kind. ``cells``: cell to (examples of the kind, others)."""
    trees: list[tuple] = []
    positive, other = (sum(c[i] for c in cells.values()) for i in (0, 1))
    if not positive:
        return [(-8.0, 0, (0, (0.0, 0.0)), (0, (0.0, 0.0)))]
    prior = math.log((positive + 1) / (other + 1))
    margins = dict.fromkeys(cells, prior)
    bits = range(len(FEATURES))
    for k in range(TREES):
        slopes = {}
        for cell, (yes, no) in cells.items():
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, margins[cell]))))
            slopes[cell] = (yes * (1 - p) - no * p, (yes + no) * p * (1 - p))

        def leaf(g: float, h: float) -> tuple[float, float]:
            return max(-4.0, min(4.0, g / (h + 1))), g * g / (h + 1)

        def best_split(part: list[int]) -> tuple[float, tuple]:
            best = (-1.0, (0, (0.0, 0.0)))
            for bit in bits:
                sums = [[0.0, 0.0], [0.0, 0.0]]
                for cell in part:
                    side = sums[cell >> bit & 1]
                    side[0] += slopes[cell][0]
                    side[1] += slopes[cell][1]
                (low, gain_low), (high, gain_high) = leaf(*sums[0]), leaf(*sums[1])
                if gain_low + gain_high > best[0] + 1e-12:
                    best = (gain_low + gain_high, (bit, (RATE * low, RATE * high)))
            return best

        chosen = None
        for root in bits:
            (gain_low, low), (gain_high, high) = (best_split([c for c in cells if c >> root & 1 == side]) for side in (0, 1))
            if chosen is None or gain_low + gain_high > chosen[0] + 1e-12:
                chosen = (gain_low + gain_high, root, low, high)
        tree = (prior if k == 0 else 0.0, *chosen[1:])
        trees.append(tree)
        for cell in cells:
            margins[cell] += _margin([(0.0, *tree[1:])], cell)
    return trees


def _seen(kind: int, cell: int) -> int:
    """The cell without what is hidden from the kind's trees."""
    return cell & ~sum(1 << FEATURES.index(name) for name in HIDDEN[kind])


def choose_cells(counts: list[tuple[bool, int, int, int]]) -> dict[int, int]:
    """Cell to kind for the cells whose proposals are redacted. ``counts``: late fold, cell, kind (-1: none), number."""
    chosen: dict[int, tuple[float, int]] = {}
    for kind in range(len(KINDS)):
        tally: dict[bool, dict[int, list[float]]] = {late: {} for late in (False, True)}
        others: dict[int, float] = {}
        for late, cell, found, n in counts:
            seen = _seen(kind, cell)
            tally[late].setdefault(seen, [0.0, 0.0])[found != kind] += n
            if found not in (kind, -1):
                others[seen] = others.get(seen, 0.0) + n
        examples = {late: sum(v[0] for v in part.values()) for late, part in tally.items()}
        if examples[False] < LEAST or not examples[True]:
            continue
        trees = boost({c: tuple(v) for c, v in tally[False].items()})
        word = {c: 1 / (1 + math.exp(-_margin(trees, c))) for c in {*tally[False], *tally[True]}}
        found_part = sum(v[0] * word[c] for c, v in tally[True].items()) / examples[True]
        for cell in {c for _, c, found, _ in counts if found == -1}:
            seen = _seen(kind, cell)
            probable = word[seen] / found_part
            own = sum(tally[late].get(seen, (0.0, 0.0))[0] for late in tally)
            # Where a cell has labelled examples, they must be of the kind.
            if probable >= PROBABLE and own >= PRECISION * (own + others.get(seen, 0.0)) and probable > chosen.get(cell, (0.0, 0))[0]:
                chosen[cell] = (probable, kind)
    return {c: kind for c, (_, kind) in sorted(chosen.items())}


def find_private(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text and more) without the text, with base and spans: arrays of (start, kind number, end), in order of start and kind.

    ``spans`` are the base spans and the proposals that the trees choose and that
    overlap no base span; of chosen ones that overlap each other the first, longest one stays. Positions
    are code points, the end exclusive. NULL counts as the empty text. Rows that repeat stay, and so do all
    other columns: where ``docs`` has one named base or spans, the new one's name begins with an underscore.
    """
    base, proposed, spans = (free_name(docs, name) for name in ("base", "proposed", "spans"))
    table = written(spans_table(docs, text), "private")
    counted = (
        table.select((F.coalesce(fold_of("doc_id"), F.lit(0)) == 3).alias("late"), F.explode_outer(proposed).alias("p")).where("p is not null")
        .groupBy("late", "p.cell", "p.kind").count())
    chosen = choose_cells([(r["late"], r["cell"], r["kind"], r["count"]) for r in counted.collect()])
    kinds = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair)) if chosen else F.create_map(F.lit(-1), F.lit(0))
    # A proposal that overlaps a base span stays out: that span is redacted as it is.
    more = F.transform(
        F.filter(proposed, lambda p: (p["kind"] == -1) & F.map_contains_key(kinds, p["cell"])),
        lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("to"), F.element_at(kinds, p["cell"]).alias("kind")))
    more = F.array_sort(more)
    first = F.aggregate(
        more, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>").alias("out")),
        lambda acc, p: F.when(p["start"] >= acc["at"], F.struct(
            (-p["to"]).alias("at"), F.concat(acc["out"], F.array(F.struct(p["start"].alias("start"), p["kind"].alias("kind"), (-p["to"]).alias("end")))).alias("out"))).otherwise(acc),
        lambda acc: acc["out"])
    return table.withColumn(spans, F.array_sort(F.concat(base, first))).drop(proposed)


def count_of(spans: Column | str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def written_out(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; a span that starts inside an earlier one is taken with it."""
    names = F.array(*map(F.lit, KINDS))
    step = lambda acc, x: F.when(x["start"] >= acc["at"], F.struct(
        x["end"].alias("at"), F.concat(acc["out"], F.array(
            F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.get(names, x["kind"]), F.lit("]")))).alias("out"))).otherwise(
        F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))
    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1)))
    return F.aggregate(spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")), step, end)
