"""Mixing a corpus to target weights, with documents that belong to domains by degrees.

Labels name domains for some documents. A naive Bayes classifier over the words that a text
holds, counted in Spark into a table of telling words and joined to the words of all
documents, gives every document a posterior over the domains. Rates, the numbers of times
that documents should be read, then solve a least squares problem: expected tokens of each
domain, the sum of rate * tokens * posterior, shall equal the targets, with no rate below
zero and the rates as near to one as that allows. Such rates are max(0, 1 - posterior . y), a projected
step from a rate of one; its few numbers y are found by Newton steps, each an aggregation over
narrow rows, of which a few numbers for each pair of domains reach the driver. Rates need no
table of their own.

All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventledger.llm.common import SPACE, long_id, text_tag, written
from eventledger.operators.numbering import totals_before
from eventledger.session import estimated_bytes

FIT_ROWS = 20_000  # labelled documents that the classifier is fitted on, at most
FULL_WORDS = 400  # evidence of longer texts counts as that of so many different words
SMOOTH = 1.0  # documents added to what a word is seen in, shared out as the domains are
#: A word's log odds count from so sure (the root of the likelihood ratio statistic) and so great an
#: effect on. Less is what chance, or a domain's share of a language, brings about. A word of
#: a domain that is one in twenty counts when three documents of it, and no others, hold it.
SURE = 4.0
EFFECT = 1.0
BROADCAST_BYTES = 64 << 20  # up to which the telling words are sent to each executor
STARTS = 64  # places at which the rounding of a domain may start
NEAR_ONE = 0.1  # rates so close to one leave a document as it is
STEPS = 30  # for each damping; a handful is usual
DAMP = 0.01  # weight of rates that differ from one, at first; a hundredth of it in each round
LEAST_DAMP = 1e-12  # the last: domains down to about this share of tokens meet their targets
LEAST_PART = 1e-6  # of a Newton step
CLOSE = 1e-6  # gap, as a share of all tokens, at which rounds end


def _words(text: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != "")


def _codes(text: str) -> Column:
    """The different words of a text as hashes: repetition is no evidence."""
    return F.array_distinct(F.transform(_words(text), lambda w: F.xxhash64(w)))


@dataclass
class Classifier:
    """Domains, their log priors, and the telling words: (code, w_0, …), log odds for each domain."""

    domains: list[str]
    prior: np.ndarray
    words: DataFrame | None


def _odds(seen: Column, own: float, rest: Column, others: float) -> Column:
    """Log odds of a word for a domain, 0 where they may be chance or are small."""
    both, every = seen + rest, own + others

    def part(found: Column, expected: Column) -> Column:
        return F.when(found > 0, found * F.log(found / expected)).otherwise(F.lit(0.0))

    unsure = 2 * (
        part(seen, both * (own / every)) + part(rest, both * (others / every))
        + part(own - seen, (every - both) * (own / every)) + part(others - rest, (every - both) * (others / every))
    )
    odds = F.log((seen + SMOOTH * own / every) / (own + SMOOTH)) - F.log((rest + SMOOTH * others / every) / (others + SMOOTH))
    return F.when((unsure >= SURE**2) & (F.abs(odds) >= EFFECT), odds).otherwise(F.lit(0.0))


def fit(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int = FIT_ROWS):
    """A classifier from ``labels(id, domain)``.

    Ids that several domains claim go to the first by name; of more than ``rows`` labelled
    ids, those with the smallest hashes are used. Equal texts of a domain count once. All words of
    these documents are counted; the telling ones are kept in a table.
    """
    once = labels.where(f"`{id_col}` IS NOT NULL AND domain IS NOT NULL").groupBy(id_col).agg(F.min("domain").alias("domain"))
    chosen = once.orderBy(F.xxhash64(id_col), id_col).limit(rows).select(F.col(id_col).cast("long").alias("_key"), "domain")
    known = (
        documents.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_key")
        .dropDuplicates(["domain", "_text"])
    )
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    domains = sorted(sizes)
    own = [float(sizes[d]) for d in domains]
    if len(domains) < 2:
        return Classifier(domains or [""], np.zeros(1), None)
    held = [F.count_if(F.col("domain") == d).alias(f"n_{i}") for i, d in enumerate(domains)]
    counted = known.select("domain", F.explode(_codes("_text")).alias("code")).groupBy("code").agg(*held)
    every = sum((F.col(f"n_{i}") for i in range(1, len(domains))), F.col("n_0"))
    odds = [_odds(F.col(f"n_{i}"), n, every - F.col(f"n_{i}"), sum(own) - n).alias(f"w_{i}") for i, n in enumerate(own)]
    telling = counted.select("code", *odds).where(F.greatest(*(F.abs(f"w_{i}") for i in range(len(domains)))) > 0)
    return Classifier(domains, np.log(np.array(own) / sum(own)), written(telling, "telling-words"))


def posteriors(documents: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_key, _tag, n_tokens, p_<number> for each domain) of every row.

    The different words of each text are joined to the telling words and summed again within
    the task that read the text; one narrow row a document is shuffled.
    """
    domains, prior = model.domains, model.prior
    rows = documents.select(
        long_id(id_col).alias("_key"), text_tag(text_col).alias("_tag"),
        F.size(_words(text_col)).cast("long").alias("n_tokens"), _codes(text_col).alias("codes"),
    )
    if model.words is None:
        return rows.select("_key", "_tag", "n_tokens", F.lit(1.0).alias("p_0"))
    words = F.broadcast(model.words) if (estimated_bytes(model.words) or 0) <= BROADCAST_BYTES else model.words
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    each = rows.select("_row", "_key", "_tag", "n_tokens", F.size("codes").alias("n"), F.explode_outer("codes").alias("code"))
    evidence = [F.coalesce(F.sum(f"w_{d}"), F.lit(0.0)).alias(f"e_{d}") for d in range(len(domains))]
    rows = each.join(words, "code", "left").groupBy("_row", "_key", "_tag", "n_tokens", "n").agg(*evidence)
    part = F.least(F.lit(1.0), F.lit(float(FULL_WORDS)) / F.greatest("n", F.lit(1)))
    rows = rows.select("_key", "_tag", "n_tokens", *((F.col(f"e_{d}") * part + float(prior[d])).alias(f"s_{d}") for d in range(len(domains))))
    top = F.greatest(*(F.col(f"s_{d}") for d in range(len(domains))))
    rows = rows.select("_key", "_tag", "n_tokens", *(F.exp(F.col(f"s_{d}") - top).alias(f"x_{d}") for d in range(len(domains))))
    total = sum((F.col(f"x_{d}") for d in range(1, len(domains))), F.col("x_0"))
    return rows.select("_key", "_tag", "n_tokens", *((F.col(f"x_{d}") / total).alias(f"p_{d}") for d in range(len(domains))))


def _rate(steps: list[np.ndarray], size: int) -> Column:
    """The rate after the steps taken so far."""
    if not steps:
        return F.lit(1.0)

    def step(rate, s):
        move = sum((F.col(f"p_{d}") * F.get(s, F.lit(d)) for d in range(1, size)), F.col("p_0") * F.get(s, F.lit(0)))
        return F.greatest(F.lit(0.0), rate - move)

    return F.aggregate(F.array(*(F.array(*(F.lit(float(x)) for x in s)) for s in steps)), F.lit(1.0), step)


def totals(rows: DataFrame, size: int, rate: Column | None = None) -> np.ndarray:
    """Expected tokens of each domain at the given rates."""
    read = F.col("n_tokens") * (F.lit(1.0) if rate is None else rate)
    summed = rows.select(read.alias("n"), *(f"p_{d}" for d in range(size))).agg(*(F.sum(F.col("n") * F.col(f"p_{d}")) for d in range(size)))
    return np.array([x or 0.0 for x in summed.first()], float)


def fit_rates(rows: DataFrame, targets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Steps that lead to the rates, and the expected tokens they give.

    The rate max(0, 1 - p . y) minimises gap^2 / damp + sum of tokens * (rate - 1)^2 where y is
    the minimum of a smooth convex function, whose gradient is damp * y less the gap: the
    projected gradient. Newton steps with a line search find it, first at a large damping, then at
    smaller ones from there, until the targets are met. Those that cannot be met leave a gap at
    the least damping: the totals nearest to them in tokens.
    """
    size = len(targets)
    pairs = [(a, b) for a in range(size) for b in range(a, size)]

    def state(y: np.ndarray):
        """Totals and squares at these rates, and the Gram matrix of documents with a rate above zero."""
        now = rows.select("n_tokens", *(f"p_{d}" for d in range(size)), _rate([y], size).alias("rate"))
        free = F.when(F.col("rate") > 0, F.col("n_tokens")).otherwise(F.lit(0))
        sums = now.agg(
            *(F.sum(F.col("n_tokens") * F.col("rate") * F.col(f"p_{d}")) for d in range(size)),
            *(F.sum(free * F.col(f"p_{a}") * F.col(f"p_{b}")) for a, b in pairs),
            F.sum(F.col("n_tokens") * F.col("rate") * F.col("rate")),
        ).first()
        gram = np.zeros((size, size))
        for (a, b), x in zip(pairs, sums[size:]):
            gram[a, b] = gram[b, a] = x or 0.0
        return np.array([x or 0.0 for x in sums[:size]], float), gram, sums[-1] or 0.0

    y = np.zeros(size)
    reached, gram, squares = state(y)
    whole = gram.sum()
    if whole <= 0:
        return [], reached

    def gap() -> float:
        return float(np.abs(reached - targets).max()) / whole

    damp = DAMP
    while gap() > CLOSE:
        for _ in range(STEPS):
            slope = (targets - reached) / whole + damp * y
            if float(np.abs(slope).max()) <= CLOSE / 10:
                break
            move = np.linalg.solve(gram / whole + damp * np.eye(size), slope)
            value = squares / whole / 2 + y @ targets / whole + damp * (y @ y) / 2
            part = 1.0
            while part > LEAST_PART:
                at = y - part * move
                tried = state(at)
                after = tried[2] / whole / 2 + at @ targets / whole + damp * (at @ at) / 2
                if after <= value - 1e-4 * part * (slope @ move) + 1e-15 * abs(value):
                    break
                part /= 4
            else:  # rounding hides what is left to gain
                break
            y, (reached, gram, squares) = at, tried
        if damp <= LEAST_DAMP:
            break
        damp /= 100
    return ([y] if y.any() else []), reached


def mix(
    documents: DataFrame,
    labels: DataFrame,
    shares: dict[str, float] | None = None,
    scale: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    fit_rows: int = FIT_ROWS,
) -> tuple[DataFrame, list[str]]:
    """Rows (_key, _tag, n_tokens, p_0, …, rate), one per document, and the domains' names.

    Targets are ``shares`` of all tokens, domains not named keeping what they hold; or the
    totals that come of reading documents mostly of a domain in ``scale`` so many times.
    Texts that are null or empty have no tokens, the
    labels' frequencies as posterior, and a rate like any other. A null id counts as the
    largest number. Rows that repeat each get the same rate. Without labels every document
    belongs to one nameless domain.
    """
    model = fit(documents, labels, id_col, text_col, fit_rows)
    domains = model.domains
    rows = written(posteriors(documents, model, id_col, text_col), "mixing")
    wanted = totals(rows, len(domains))
    if shares:
        wanted = np.array([shares[name] * wanted.sum() if name in shares else x for name, x in zip(domains, wanted)])
    elif scale:
        mostly = [F.when(F.col(f"p_{d}") > 0.5, float(scale[name])) for d, name in enumerate(domains) if name in scale]
        wanted = totals(rows, len(domains), F.coalesce(*mostly, F.lit(1.0)))
    steps, _ = fit_rates(rows, wanted)
    return rows.select("*", _rate(steps, len(domains)).alias("rate")), domains


def copies(rate: Column, key: Column, seed: int = 7) -> Column:
    """Whole numbers of copies with the rate as expectation, decided by a hash of the key."""
    chance = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + chance).cast("int")


def as_it_is(rate: Column) -> Column:
    """Whether a rate is so near one that a document is read once."""
    return F.abs(rate - 1) <= NEAR_ONE


def whole_copies(rated: DataFrame, size: int) -> DataFrame:
    """Rows of ``mix`` with ``copies``, how often to read each document.

    A rate within ``NEAR_ONE`` of one leaves a document as it is. The others are rounded together:
    laid one after the other, by domain and number of tokens, a document is read once for each
    whole number that its rate passes, so documents like one another make up for each other.
    Where the count starts is free: of ``STARTS`` places each domain takes the one whose tokens
    come nearest to those of the rates.
    """
    staged = written(rated.withColumn("_row", F.monotonically_increasing_id()), "rates")
    most = F.greatest(*(F.col(f"p_{d}") for d in range(size))) if size > 1 else F.col("p_0")
    domain = F.coalesce(*(F.when(F.col(f"p_{d}") == most, d) for d in range(size)))
    as_is = as_it_is(F.col("rate"))
    order = ["_domain", "n_tokens", "_mixed", "_row"]
    others = staged.where(~as_is).select("_row", "n_tokens", "rate", domain.alias("_domain"), F.xxhash64("_key", "_tag").alias("_mixed"))
    before = totals_before(others, order, "rate").withColumn("before", F.col("before").cast("double"))
    places = written(before.select("_row", "_domain", "before", "rate", "n_tokens"), "places")

    def passed(start: Column | float) -> Column:
        return F.floor(F.col("before") + F.col("rate") + start) - F.floor(F.col("before") + start)

    starts = [j / STARTS for j in range(STARTS)]
    tokens = [F.sum(F.col("n_tokens") * passed(start)).alias(f"t{j}") for j, start in enumerate(starts)]
    best = {}
    for r in places.groupBy("_domain").agg(F.sum(F.col("n_tokens") * F.col("rate")).alias("wanted"), *tokens).collect():  # a row a domain
        best[r["_domain"]] = min(starts, key=lambda start: abs(r[f"t{starts.index(start)}"] - r["wanted"]))
    start = F.coalesce(*(F.when(F.col("_domain") == d, u) for d, u in best.items()), F.lit(0.0))
    dealt = places.select("_row", passed(start).alias("_passed"))
    rows = staged.join(dealt, "_row", "left")
    return rows.select(*rated.columns, F.when(as_is, 1).otherwise(F.col("_passed")).cast("int").alias("copies"))


def quality_domains(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, domain): toxic, else low or good by quality; rows without a quality go."""
    return labels.where("quality IS NOT NULL").select(
        id_col, F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").otherwise("good").alias("domain")
    )
