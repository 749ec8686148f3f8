"""One best record of each group of duplicates, field by field, by Bayesian fusion with copy detection.

Sources are the origins of the cards. A source's claim on a field of a record is the value of its
latest card that says something. Rounds of estimation alternate: the posterior of each claimed value
from the accuracies of the sources that claim it, the accuracy of a source as the mean posterior of
its claims, and the dependence of each pair of sources from how often they share false values; the
vote of a source that copies is discounted. Where an order of trust is given whose steps outweigh all votes,
no vote can change the winner; then nothing is estimated, and the order alone is applied in one pass.

A record is one row with a column per source from the first aggregation on, so a group of any size is
reduced on the map side, no pairs of rows are made, and the rounds are narrow scans that send a few
numbers to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

FIELDS = ("clothes", "description", "signature")
#: Sources by trust; every other source, and null, counts as the last one.
TRUST = ("user", "gemini", "local")
OTHER = "other"
#: Texts that only stand for a missing value, in lower case without outer blanks; "none" is a value, as of a person without glasses.
STAND_INS = (
    "unknown", "unk", "n/a", "na", "n.a.", "null", "nil", "nan", "not available", "not known",
    "not visible", "not specified", "unspecified", "unreadable", "illegible", "missing", "no data", "empty",
    "blank", "undefined", "undetermined", "unclear", "tbd", "tba", "see prior card", "see above", "see notes",
    "same as before", "as before",
)


@dataclass
class SourceModel:
    """What the rounds estimated: accuracy by source, dependence by pair, rounds taken."""

    accuracy: dict[str, float]
    dependence: dict[tuple[str, str], float] = field(default_factory=dict)
    rounds: int = 0


def says_something(text: Column) -> Column:
    """Whether a text holds a value: not null, blank, without letters and digits, or a stand-in."""
    bare = F.regexp_replace(F.lower(text), r"^[\s ]+|[\s ]+$", "")
    return F.coalesce(bare.rlike(r"[\p{L}\p{N}]") & ~bare.isin(*STAND_INS), F.lit(False))


def _agreed(text: Column) -> Column:
    """A value as it is compared: lower case, single blanks, no final punctuation."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(text), r"[\s ]+", " ")), r"[\s.,;]+$", "")


def claims(cards: DataFrame, fields: Sequence[str] = FIELDS, trust: Sequence[str] = TRUST) -> DataFrame:
    """One row for each record (``id``) of two or more cards and each field that some card fills.

    Columns ``id, field`` and for each source a struct of its claim: ``updated_at, card_id, value``.
    The latest card of a source speaks for it, of equally late ones the largest ``card_id``.
    """
    origins = [*trust, OTHER]
    source = F.coalesce(F.col("source"), F.lit(OTHER))
    source = F.when(source.isin(*trust), source).otherwise(OTHER)
    rows = cards.where("id is not null and card_id is not null").select(
        "id", "card_id", "updated_at", source.alias("origin"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]
    )
    best = [
        F.max(F.when((F.col("origin") == o) & says_something(F.col(f"f{i}")), F.struct("updated_at", "card_id", F.col(f"f{i}").alias("value")))).alias(
            f"f{i}_{j}"
        )
        for i in range(len(fields))
        for j, o in enumerate(origins)
    ]
    grouped = rows.groupBy("id").agg(F.min("card_id").alias("low"), F.max("card_id").alias("high"), *best).where("low <> high")
    by_field = [
        F.struct(F.lit(f).alias("field"), *[F.col(f"f{i}_{j}").alias(f"c{j}") for j in range(len(origins))]) for i, f in enumerate(fields)
    ]
    return (
        grouped.select("id", F.explode(F.array(*by_field)).alias("x"))
        .select("id", "x.*")
        .where(F.coalesce(*[f"c{j}" for j in range(len(origins))]).isNotNull())
    )


class _Votes:
    """Posterior expressions over the claim columns of one row."""

    def __init__(self, n: int, model: list[float], discount: list[list[float]], false_values: int):
        self.n = n
        self.key = [F.col(f"k{j}") for j in range(n)]
        weights = [math.log(false_values * a / (1 - a)) for a in model]
        # A vote counts for what it is worth if it isn't copied from an equal claim of another source.
        self.vote = [
            F.lit(weights[j])
            * reduce(
                lambda x, y: x * y,
                [F.when(self.key[t] == self.key[j], 1 - discount[j][t]).otherwise(1.0) for t in range(n) if t != j],
                F.lit(1.0),
            )
            for j in range(n)
        ]
        self.score = [
            F.when(
                self.key[j].isNotNull(),
                reduce(lambda x, y: x + y, [F.when(self.key[t] == self.key[j], self.vote[t]).otherwise(0.0) for t in range(n)]),
            )
            for j in range(n)
        ]
        first = [
            self.key[j].isNotNull() & ~F.coalesce(reduce(lambda x, y: x | y, [F.coalesce(self.key[t] == self.key[j], F.lit(False)) for t in range(j)], F.lit(False)), F.lit(False))
            for j in range(n)
        ]
        mass = [F.when(first[j], F.exp(self.score[j])).otherwise(0.0) for j in range(n)]
        told = reduce(lambda x, y: x + y, [F.when(f, 1).otherwise(0) for f in first])
        rest = F.greatest(F.lit(0.0), F.lit(float(false_values + 1)) - told)
        total = reduce(lambda x, y: x + y, mass) + rest
        self.posterior = [F.exp(self.score[j]) / total for j in range(n)]


def estimate(
    items: DataFrame, n: int, rounds: int = 4, false_values: int = 20, copied: float = 0.2, copy_rate: float = 0.8
) -> tuple[list[float], list[list[float]]]:
    """Accuracies and pairwise copy discounts of the ``n`` sources of ``items`` (``k0..``: compared claims).

    ``false_values`` is the number of false values a field may take, ``copied`` the prior probability
    that two sources depend, ``copy_rate`` the share of values a copier copies. An item of one claim says
    nothing about accuracy beyond its prior; the estimates are kept in [0.05, 0.95]. The first pass only looks for
    dependence, by how often sources agree at all: copies that vote in full would otherwise make their own errors
    true, and the errors of all others shared false values.
    """
    accuracy = [0.8] * n
    discount = [[0.0] * n for _ in range(n)]
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    for turn in range(rounds + 1 if rounds else 0):
        votes = _Votes(n, accuracy, discount, false_values)
        scored = items.select(*[votes.key[j].alias(f"k{j}") for j in range(n)], *[votes.posterior[j].alias(f"p{j}") for j in range(n)])
        sums = []
        for j in range(n):
            contested = reduce(lambda x, y: x | y, [F.col(f"k{t}").isNotNull() for t in range(n) if t != j])
            sums.append(F.avg(F.when(contested, F.col(f"p{j}"))).alias(f"a{j}"))
        for i, j in pairs:
            same = F.col(f"k{i}") == F.col(f"k{j}")
            sums += [
                F.sum(F.when(same, F.col(f"p{i}"))).alias(f"t{i}_{j}"),
                F.sum(F.when(same, 1 - F.col(f"p{i}"))).alias(f"f{i}_{j}"),
                F.sum(F.when(~same, 1.0)).alias(f"d{i}_{j}"),
            ]
        seen = scored.agg(*sums).first()
        if turn:
            accuracy = [min(0.95, max(0.05, seen[f"a{j}"] if seen[f"a{j}"] is not None else accuracy[j])) for j in range(n)]
        for i, j in pairs:
            kt, kf, kd = (seen[f"{x}{i}_{j}"] or 0.0 for x in "tfd")
            ai, aj = accuracy[i], accuracy[j]
            true_, false_ = ai * aj, (1 - ai) * (1 - aj) / false_values
            a = (ai + aj) / 2
            likely = (
                kt * math.log(true_ / (a * copy_rate + true_ * (1 - copy_rate)))
                + kf * math.log(false_ / ((1 - a) * copy_rate + false_ * (1 - copy_rate)))
                + kd * -math.log(1 - copy_rate)
            )
            if not turn:
                by_chance = true_ + false_
                likely = (kt + kf) * math.log(by_chance / (copy_rate + by_chance * (1 - copy_rate))) + kd * -math.log(1 - copy_rate)
            odds = math.log((1 - copied) / copied) + likely
            depends = 1 / (1 + math.exp(min(700.0, max(-700.0, odds))))
            # Either may be the copier: the less accurate one loses its vote.
            loser, other = (i, j) if ai < aj else (j, i)
            discount[loser][other] = copy_rate * depends
            discount[other][loser] = 0.0
    return accuracy, discount


def fuse(
    cards: DataFrame, fields: Sequence[str] = FIELDS, trust: Sequence[str] = TRUST, rounds: int = 4, false_values: int = 20
) -> tuple[DataFrame, SourceModel]:
    """The surviving value of each field of each record that has two or more cards, by the greatest posterior.

    ``cards``: ``id, card_id, source, updated_at`` and the fields; further columns are ignored. Returns
    ``id, field, value, card_id, source, posterior`` and the estimated model. The prior is flat, so the votes
    of the sources decide; of equal posteriors the more trusted source's value survives. Within a
    source its latest card speaks. Null ``updated_at`` is the oldest; a card in two rows is one card; rows
    without ``id`` or ``card_id`` are no cards; fields in which no card says anything have no row.
    """
    names = [*trust, OTHER]
    n = len(names)
    items = cut(claims(cards, fields, trust))
    compared = items.select("*", *[_agreed(F.col(f"c{j}.value")).alias(f"k{j}") for j in range(n)])
    accuracy, discount = estimate(compared, n, rounds, false_values)
    votes = _Votes(n, accuracy, discount, false_values)
    ranked = [
        F.when(F.col(f"c{j}").isNotNull(), F.struct(votes.score[j].alias("log_posterior"), F.lit(-j).alias("trust"), votes.posterior[j].alias("posterior"), *_origin(j, names[j])))
        for j in range(n)
    ]
    best = compared.select("id", "field", F.greatest(*ranked).alias("b"))
    pairs = {(names[i], names[j]): discount[i][j] for i in range(n) for j in range(n) if i != j}
    return best.select("id", "field", "b.value", "b.card_id", "b.source", "b.posterior"), SourceModel(dict(zip(names, accuracy, strict=True)), pairs, rounds)


def _origin(j: int, source: str) -> tuple[Column, ...]:
    return F.lit(source).alias("source"), F.col(f"c{j}.card_id").alias("card_id"), F.col(f"c{j}.value").alias("value")


def by_order(cards: DataFrame, fields: Sequence[str] = FIELDS, trust: Sequence[str] = TRUST) -> DataFrame:
    """``id, field, value, card_id, source`` as ``fuse``, where the order of trust decides alone: the most trusted source that says something.

    It is the fusion under a prior whose steps no sum of votes outweighs, so nothing has to be estimated.
    """
    names = [*trust, OTHER]
    told = F.coalesce(*[F.when(F.col(f"c{j}").isNotNull(), F.struct(*_origin(j, s))) for j, s in enumerate(names)])
    return claims(cards, fields, trust).select("id", "field", told.alias("b")).select("id", "field", "b.value", "b.card_id", "b.source")


def best_cards(cards: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """One row per record of two or more cards: each field's best value and the card it came from."""
    return by_order(cards, fields).groupBy("id").agg(
        *[F.max(F.when(F.col("field") == f, F.col(c))).alias(name) for f in fields for c, name in (("value", f), ("card_id", f"{f}_card"))]
    )
