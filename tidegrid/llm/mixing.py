"""Mixing towards target weights with soft domain membership. DataFrame functions only."""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import stage

SLOTS = 1 << 17  # of each of two tables of common telling signs that every task holds (4 MB and 2 MB a domain); all others meet their weights by a join
MIN_DOCS = 5  # labelled documents that hold a sign at least
SMOOTH = 1.0
FOLDS = 5  # the heat is chosen on one of so many parts of the labelled documents, by weights of the others
HEATS = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 32.0, 48.0, 64.0, 96.0, 128.0, 192.0, 256.0)
STIFF = 1e-3  # weight of staying at rate 1, against the targets
STILL = 1e-9  # slope of the fit, as a share of all tokens, that counts as none
STEPS = 1000  # steps at most; some ten passes over the rows meet the least value
GRIDS, CELLS = (64, 32, 16, 8, 4, 2), 4000  # of rounded posteriors, finest first, and how many cells may start the fit
FILTER_BITS = 1 << 26  # of a bit filter at most, 8 MB


def with_signs(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with ``__n``, the number of words of the text, and ``__held``, the distinct hashes of its signs: its lower-cased
    words and a few binned counts, as strings. A null text is an empty one.

    Words are hashed where they are cut, and one pass leaves of the text what is counted, so that no arrays of words are made
    between steps."""
    t = F.col("__t")
    words = F.array_remove(F.split(F.regexp_replace(F.lower(t), r"[\x09-\x0D]", " "), " ", -1), "")
    out = docs.withColumn("__t", F.coalesce(F.col(text_col), F.lit("")))
    out = out.withColumns({"__w": F.transform(words, lambda w: F.xxhash64(w)), "__c": F.regexp_replace(t, r"[^\n!#$%&()*+/<=>?@\[\\\]^_{|}~]+", "")})
    n, odd = F.size("__w"), F.char_length(F.replace(F.col("__c"), F.lit("\n"), F.lit("")))
    lines = F.char_length("__c") - odd
    counts = (
        F.concat(F.lit("\tn"), F.floor(F.log2(n + F.lit(1)))),
        F.concat(F.lit("\to"), F.floor(2 * F.log1p(100 * odd / (n + F.lit(10))))),
        F.concat(F.lit("\tl"), F.floor(2 * F.log2((F.char_length(t) + F.lit(1)) / (n + F.lit(1))))),
        F.concat(F.lit("\tb"), F.floor(F.log1p(100 * lines / (n + F.lit(10))))),
    )
    return out.withColumns({"__n": n.cast("long"), "__held": F.array_distinct(F.concat("__w", F.array(*map(F.xxhash64, counts))))}).drop("__t", "__w", "__c")


def bit_filter(hashes: DataFrame, col: str) -> tuple[DataFrame, int]:
    """A staged table of one row, ``bits``: an array of 64-bit words with a bit set for each hash, and the bits' number.

    Some 32 bits per hash, at most 8 MB: with more hashes it passes more of what it should not, never less of what it
    should. What passes still meets the hashes by a join."""
    size = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (32 * hashes.count()).bit_length()))
    at = F.col(col).bitwiseAND(F.lit(size - 1))
    zeros = hashes.sparkSession.range(size // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
    real = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, CAST(`{col}` & 63 AS INT))").alias("b"))
    words = zeros.unionByName(real).groupBy("w").agg(F.bit_or("b").alias("b"))
    return stage(words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("bits")), "bits"), size


def may_hold(bits: str, size: int, h: Column) -> Column:
    """Whether a hash may be in the filter; ``bits`` is a column with its words."""
    at = h.bitwiseAND(F.lit(size - 1))
    word = F.element_at(bits, F.shiftright(at, 6).cast("int") + 1)
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


class Classifier:
    """Naive Bayes over the telling signs, whose evidence is divided by a heat, which makes its posteriors soft."""

    def __init__(self, domains: list[str], share: list[float], absent: list[float], absent_part: list[float], weights: DataFrame | None):
        """Log shares of the domains, log likelihoods of a text without any sign, by all labelled documents and by those
        outside the first fold, and a staged table of what each telling sign adds: (__h, n, __g0.., __b0..), with a
        64-bit hash of the sign. Its rows grow with the labelled documents."""
        self.domains, self.share, self.absent, self.absent_part, self.weights = domains, share, absent, absent_part, weights

    def score(self, rows: DataFrame, held: str) -> DataFrame:
        """rows without ``held`` and ``__row``, with z0.., the log likelihood under each domain, and y0.., that by the weights
        without the first fold; ``held`` is an array of distinct hashes, at least one, ``__row`` numbers the rows.

        A sign's weights are looked up in two tables of slots, whose taken ones are broadcast to every executor: the most common
        sign of each slot by the low bits of its hash, and of those left out by the bits above. So no more is broadcast than there
        are telling signs, and 2 SLOTS rows at most. Signs left out of both meet a table of weights by hash, where no sign is
        common. All are summed by row at once."""
        k = range(len(self.domains))
        add = [f"__{c}{i}" for c in "gb" for i in k]
        each = rows.select("__row", F.explode(held).alias("__h"))
        rest, here = self.weights, each
        for table, shift in (("__one", 0), ("__two", SLOTS.bit_length() - 1)):
            slot = lambda h: F.shiftright(h, shift).bitwiseAND(F.lit(SLOTS - 1)).cast("int")  # noqa: B023, E731
            first = rest.groupBy(slot(F.col("__h")).alias("slot")).agg(F.max_by(F.struct("__h", *add), F.struct("n", "__h")).alias("w"))
            empty = rows.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
            slots = stage(empty.join(first, "slot", "left").select(F.col("slot").alias(table), F.col("w.__h").alias(f"{table}__h"), *(F.col(f"w.{c}").alias(table + c) for c in add)), "slots")
            taken = slots.filter(F.col(f"{table}__h").isNotNull())  # empty ones would fill the driver, which builds what is broadcast
            here = here.join(F.broadcast(taken), slot(F.col("__h")) == F.col(table), "left")  # each met by one at most; as a value it would go with every task
            rest = stage(rest.join(first.select("w.__h"), "__h", "left_anti"), "rest")
        mine = lambda table: F.col(f"{table}__h") == F.col("__h")
        near = here.select("__row", *[F.when(mine("__one"), F.col(f"__one{c}")).when(mine("__two"), F.col(f"__two{c}")).otherwise(0.0).alias(c) for c in add])
        bits, size = bit_filter(rest, "__h")
        left = each.withColumn("__bits", bits.scalar()).filter(may_hold("__bits", size, F.col("__h"))).drop("__bits")
        far = left.join(rest.select("__h", *add).hint("merge"), "__h").drop("__h")
        sums = stage(near.unionByName(far).groupBy("__row").agg(*(F.sum(c).alias(c) for c in add)), "sums")
        met = rows.drop(held).join(sums.hint("merge"), "__row")
        logs = [(F.lit(x) + F.col(c)).alias(f"{'z' if c[2] == 'g' else 'y'}{c[3:]}") for c, x in zip(add, [*self.absent, *self.absent_part])]
        return met.select(*(c for c in rows.columns if c not in (held, "__row")), *logs)


def train(labelled: DataFrame, text_col: str, domain_col: str) -> Classifier:
    """Counts of every sign in every labelled document. Telling are all signs of MIN_DOCS documents whose information
    gain is beyond what the best of as many signs would have by chance: twice the gain is chi-squared, over
    2 log n with a chance of 1 / n for three domains. Tables are staged, only sums come to the driver. Rows without a
    domain are left out; no rows give a classifier without domains. ``__fold`` tells a row's fold, if there."""
    fold = F.col("__fold") if "__fold" in labelled.columns else F.lit(1)
    return _learn(with_signs(labelled.select(F.col(domain_col).alias("__d"), fold.alias("__fold"), F.col(text_col).alias("__text")), "__text").select(F.col("__d").alias("domain"), "__fold", F.col("__held").alias("held")))


def _learn(labelled: DataFrame) -> Classifier:
    """train() on (domain, __fold, held), with the hashes of a row's signs."""
    rows = labelled.filter("domain IS NOT NULL").select(F.col("domain").cast("string").alias("d"), (F.col("__fold") != 0).alias("in_part"), "held")
    size, part = {}, {}
    for r in rows.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("in_part"), 1)).alias("m")).orderBy("d").collect():  # a row per domain
        size[r["d"]], part[r["d"]] = r["n"], r["m"]
    names, total = sorted(size), sum(size.values())
    if not names:
        return Classifier([], [], [], [], None)
    held = rows.select("d", (F.col("in_part").cast("long") * (1 << 32) + 1).alias("x"), F.explode("held").alias("__h"))
    # two counts in one sum, of fewer than 2^31 documents each: of all in the low half, of those outside the fold in the high one
    sums = held.groupBy("__h").agg(*[F.coalesce(F.sum(F.when(F.col("d") == n, F.col("x"))), F.lit(0)).alias(f"x{k}") for k, n in enumerate(names)])
    low, high = (lambda k: F.col(f"x{k}").bitwiseAND(F.lit((1 << 32) - 1))), (lambda k: F.shiftright(f"x{k}", 32))
    counts = sums.select("__h", sum((low(k) for k in range(len(names))), F.lit(0)).alias("n"), *(low(k).alias(f"c{k}") for k in range(len(names))), *(high(k).alias(f"m{k}") for k in range(len(names))))
    counts = stage(counts.filter(F.col("n") >= MIN_DOCS), "counts")
    tested = counts.count()

    def entropy(cols: list[Column], n: Column) -> Column:
        return sum((F.when(c > 0, -c * F.log(c / n)).otherwise(F.lit(0.0)) for c in cols), F.lit(0.0))

    inside = [F.col(f"c{k}") for k in range(len(names))]
    outside = [F.lit(size[n]) - F.col(f"c{k}") for k, n in enumerate(names)]
    whole = sum(-n * math.log(n / total) for n in size.values())
    told = F.lit(whole) - entropy(inside, F.col("n")) - entropy(outside, F.greatest(F.lit(total) - F.col("n"), F.lit(1)))
    share = [math.log((size[n] + SMOOTH) / (total + SMOOTH * len(names))) for n in names]
    every = [(F.col(f"c{k}") + F.lit(SMOOTH)) / F.lit(size[n] + 2 * SMOOTH) for k, n in enumerate(names)]
    others = [(F.col(f"m{k}") + F.lit(SMOOTH)) / F.lit(part[n] + 2 * SMOOTH) for k, n in enumerate(names)]
    telling = counts.filter(2 * told > F.lit(2 * math.log(max(tested, 2))))
    adds = [(F.log(q) - F.log(1 - q)).alias(f"__{c}{k}") for c, p in (("g", every), ("b", others)) for k, q in enumerate(p)]
    none = [F.log(1 - q).alias(f"__{c}a{k}") for c, p in (("g", every), ("b", others)) for k, q in enumerate(p)]
    weights = stage(telling.select("__h", "n", *adds, *none), "weights")
    row = weights.agg(*(F.sum(f"__{c}a{k}") for c in "gb" for k in range(len(names)))).first()
    absent = [x or 0.0 for x in row]
    return Classifier(names, share, absent[: len(names)], absent[len(names) :], weights)


def _softmax(names: list[str], prior: list[float], heat: float) -> dict[str, Column]:
    z = [F.lit(prior[k]) + F.col(f"z{k}") / F.lit(heat) for k in range(len(names))]
    top = F.greatest(*z) if len(z) > 1 else z[0]
    parts = [F.exp(x - top) for x in z]
    return {f"p{k}": p / sum(parts[1:], parts[0]) for k, p in enumerate(parts)}


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """(doc_id, keep.., n_tokens, p0, p1..) for each row of docs, and the domains in order.

    ``labels`` is (doc_id, domain), one row per document; every row of a document that docs repeats is labelled. The
    heat is the one with the least log loss on a fifth of the labelled documents, by the weights of the
    others. Without a labelled row there is one domain, ``all``, and p0 is 1; so it is in an empty table. ``keep`` must not
    hold names of other result columns."""
    _clear(keep)
    fold = F.pmod(F.xxhash64(F.lit("fold"), "__id"), F.lit(FOLDS))
    ids = stage(labels.select(F.col("doc_id").alias("__id"), F.xxhash64("doc_id").alias("__ih"), "domain").filter("__id IS NOT NULL"), "labels")
    bits, size = bit_filter(ids, "__ih")
    own = with_signs(docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("__text")), "__text")
    own = own.select("doc_id", *keep, F.col("__n").alias("n_tokens"), F.col("__held").alias("held"))
    own = stage(own.withColumn("__row", F.monotonically_increasing_id()), "held")  # the one pass over texts
    some = own.select(F.col("doc_id").alias("__id"), "held", bits.scalar().alias("__bits")).filter(may_hold("__bits", size, F.xxhash64("__id"))).drop("__bits")
    labelled = some.join(ids.drop("__ih").hint("merge"), "__id")  # one way at every size
    model = _learn(labelled.withColumn("__fold", fold))
    if not model.domains:
        return stage(own.select("doc_id", *keep, "n_tokens", F.lit(1.0).alias("p0")), "posteriors"), ["all"]
    scored = stage(model.score(own, "held"), "logits")
    tried = scored.select("doc_id", *(F.col(f"y{k}").alias(f"z{k}") for k in range(len(model.domains))))
    known = stage(tried.join(ids.filter(fold == 0).select(F.col("__id").alias("doc_id"), "domain").hint("merge"), "doc_id"), "tried_logits")
    losses = []
    for heat in HEATS:
        p = _softmax(model.domains, model.share, heat)
        mine = F.lit(0.0)
        for k, name in enumerate(model.domains):
            mine = F.when(F.col("domain") == name, p[f"p{k}"]).otherwise(mine)
        losses.append(F.avg(-F.log(F.greatest(mine, F.lit(1e-12)))))
    row = known.agg(*losses).first()
    heat = min((x, h) for x, h in zip(row, HEATS))[1] if row[0] is not None else HEATS[0]
    return stage(scored.withColumns(_softmax(model.domains, model.share, heat)).drop(*(f"{c}{k}" for c in "zy" for k in range(len(model.domains)))), "posteriors"), model.domains


def _descend(look, u: np.ndarray, white: np.ndarray, still: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectral gradient steps from u to where the slope is at most ``still``, and that slope. ``look(u)`` gives value and
    slope; steps are whitened, as long as the last two slopes say, and a fourth of that while the value stays above the
    worst of the last five and the slope does not halve."""
    value, slope = look(u)
    values, t = [value], 1.0
    for _ in range(STEPS):
        if np.abs(slope).max() <= still:
            break
        step = np.linalg.solve(white, slope)
        while True:
            new = u - t * step
            v, g = look(new)
            if v <= max(values[-5:]) - 1e-4 * t * (slope @ step) + 1e-12 * abs(value) or np.abs(g).max() < np.abs(slope).max() / 2 or t < 1e-9:
                break
            t /= 4
        moved, turned = new - u, g - slope
        t = float(np.clip((moved @ white @ moved) / max(moved @ turned, 1e-300), 1e-6, 1e4))
        u, value, slope = new, v, g
        values.append(v)
    return u, slope


def fit_rates(rows: DataFrame, domains: int, targets: list[float], stiff: float = STIFF) -> tuple[DataFrame, list[float]]:
    """rows with ``rate``, and what is left between expected and target tokens of each domain, as shares of all tokens.

    Nonnegative least squares for sum_i p_id n_i rate_i = target_d by projected gradients: the value is
    e' M^-1 e / 2 + stiff/2 sum_i n_i (rate_i - 1)^2 for e = expected - target, M being the sum of n_i p_i p_i'. Rates
    are the projection max(0, 1 - p_i u / stiff) of a gradient step by a multiplier u per domain, and u moves along the
    slope M u + target - expected(u) until that is gone; a step is one pass of sums over narrow rows.

    Steps start from the multipliers of at most some 4,000 cells of like rows (posteriors rounded to the finest of six
    grids that give no more), which the driver works out in the same way and whose rows with a rate above 0 whiten
    the steps. That only saves passes: the end is set by the sums over all rows."""
    k = range(domains)
    pairs = [(i, j) for i in k for j in range(i + 1)]
    grid = lambda res: F.array(*[F.round(F.col(f"p{i}") * res).cast("int") for i in k])
    some = rows.filter("n_tokens > 0")
    first = some.agg(F.sum("n_tokens"), *(F.sum(F.col(f"p{i}") * F.col(f"p{j}") * F.col("n_tokens")) for i, j in pairs), *(F.approx_count_distinct(grid(res)) for res in GRIDS)).first()
    total, goal = first[0] or 0, np.array(targets, float)
    if not total:
        return rows.withColumn("rate", F.lit(1.0)), [0.0] * domains

    def square(sums) -> np.ndarray:
        m = np.zeros((domains, domains))
        for x, (i, j) in zip(sums, pairs):
            m[i, j] = m[j, i] = x or 0.0
        return m

    m = square(first[1 : 1 + len(pairs)]) + 1e-9 * total * np.eye(domains)
    res = next((r for r, n in zip(GRIDS, first[1 + len(pairs) :]) if n <= CELLS), GRIDS[-1])
    cells = some.groupBy(grid(res)).agg(F.sum("n_tokens"), *(F.sum(F.col(f"p{i}") * F.col("n_tokens")) for i in k)).collect()  # bounded by the grid
    mass = np.array([c[1] for c in cells], float)
    mean = np.array([c[2:] for c in cells], float) / mass[:, None]

    def roughly(u: np.ndarray) -> tuple[float, np.ndarray]:
        r = np.maximum(0, 1 - mean @ u / stiff)
        return u @ m @ u / 2 + u @ goal + stiff / 2 * (mass * r * r).sum(), m @ u + goal - (mean * (mass * r)[:, None]).sum(0)

    def rate(u: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p{i}") * F.lit(float(x / stiff)) for i, x in enumerate(u)), F.lit(0.0)))

    def exactly(u: np.ndarray) -> tuple[float, np.ndarray]:
        n = F.col("n_tokens") * F.col("__r")
        x = [v or 0.0 for v in some.withColumn("__r", rate(u)).agg(F.sum(n * F.col("__r")), *(F.sum(F.col(f"p{i}") * n) for i in k)).first()]
        return u @ m @ u / 2 + u @ goal + stiff / 2 * x[0], m @ u + goal - np.array(x[1:])

    u, _ = _descend(roughly, np.zeros(domains), m * (1 + 1 / stiff), STILL * total)
    live = mass * (mean @ u < stiff)
    u, slope = _descend(exactly, u, m + (mean * live[:, None]).T @ mean / stiff, STILL * total)
    return rows.withColumn("rate", rate(u)), ((m @ u - slope) / total).tolist()


def _clear(keep: tuple[str, ...]) -> None:
    clash = [c for c in keep if c in ("doc_id", "n_tokens", "rate", "held", "domain") or c.startswith("__") or re.fullmatch(r"[pyz]\d+", c)]
    if clash or len(set(keep)) != len(keep):
        raise ValueError(f"columns {clash or list(keep)} clash with those of the result")


def copies(rate: str, id_col: str, seed: int = 11) -> Column:
    """Whole copies of a document: the rate's whole part, and one more with its fraction's chance, by id hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (u < F.col(rate) - F.floor(rate)).cast("long")).cast("int")


def domain_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): ``toxic``, or else ``good`` or ``poor`` by quality; a document labelled twice counts by
    its worst labels, rows without an id or a label are left out."""
    one = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return one.select("doc_id", F.when(F.col("t") == 1, "toxic").when(F.col("q") == 1, "good").when(F.col("q") == 0, "poor").alias("domain")).filter("domain is not null")


def targets_of(rows: DataFrame, domains: list[str], weights: dict[str, float], relative: bool) -> list[float]:
    """Token targets: ``weights`` are shares of all tokens, or, if relative, factors on what a domain has.

    Domains without a weight get no tokens (relative: keep theirs); shares of domains that no label has are
    spread over the others in proportion."""
    mass = [x or 0.0 for x in rows.agg(*(F.sum(F.col(f"p{k}") * F.col("n_tokens")) for k in range(len(domains)))).first()]
    if relative:
        return [max(0.0, weights.get(d, 1.0)) * m for d, m in zip(domains, mass)]
    known = [max(0.0, weights.get(d, 0.0)) for d in domains]
    return [sum(mass) * w / sum(known) for w in known] if sum(known) else mass


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], relative: bool = False, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[float]]:
    """(doc_id, keep.., n_tokens, p0.., rate) of each row of docs, the domains, and what is left to their targets as shares
    of all tokens: nonnegative rates whose expected tokens by domain meet the targets as far as staying near 1 lets them.

    Null and empty texts have no tokens and rate as their posteriors say; rows that repeat, and rows with a null id, are rows
    of their own; an empty table gives no rows. Extra columns of docs play no part unless kept; ``keep`` must not hold names of
    the other result columns."""
    rows, domains = posteriors(docs, labels, id_col, text_col, keep)
    out, gap = fit_rates(rows, len(domains), targets_of(rows, domains, weights, relative))
    return out, domains, gap


def resample(docs: DataFrame, labels: DataFrame, weights: dict[str, float], relative: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, each as many times as its copies; rows with a null id stay once."""
    rows, _, _ = mix(docs, labels, weights, relative, id_col, text_col)
    times = rows.filter("doc_id is not null").groupBy("doc_id").agg(F.max("rate").alias("__rate")).withColumnRenamed("doc_id", "__id").withColumn("__copies", copies("__rate", "__id"))
    met = docs.join(stage(times, "copies"), docs[id_col] == F.col("__id"), "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return met.filter("__copies > 0").withColumn("__nth", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(docs[c] for c in docs.columns))
