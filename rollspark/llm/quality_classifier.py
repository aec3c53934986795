"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Byte classes: lower, upper, digit, space, full stops and the like, other symbols, bar, bytes of other scripts.
_CLASS = np.full(256, 7, np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:'\"?-()" else 6 if _c == "|" else 5
#: Numbers of the text as a whole, then shares of hashed words and of hashed pairs of words.
N_SHAPE, N_WORDS, N_PAIRS = 14, 64, 64
N_FEATURES = N_SHAPE + N_WORDS + N_PAIRS


def text_features(text: str | None) -> np.ndarray:
    """Fixed numbers that describe a whole text: its shape, its words and its pairs of words; null counts as empty."""
    raw = (text or "").encode()
    words = raw.lower().split()
    n = max(1, len(words))
    share = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) / max(1, len(raw))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again = sum(map(bytes.__eq__, words[1:], words[:-1])) / n
    shape = [np.log1p(len(words)), min(len(raw) / n, 50.0) / 10, len(set(words)) / n, again, 1 - len(set(lines)) / max(1, len(lines)), len(lines) / n, *share]
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) >> np.uint64(16)
    hashed = [np.bincount((x % np.uint64(k)).astype(np.int64), minlength=k) / n for x, k in ((h, N_WORDS), (pairs, N_PAIRS))]
    return np.concatenate([shape, *hashed])


def with_features(rows: DataFrame) -> DataFrame:
    """Add ``x``, the features of the column ``text``, and drop the text."""

    def add(batches):
        for batch in batches:
            values = [text_features(t) for t in batch.column("text").to_pylist()]
            flat = pa.array(np.concatenate(values) if values else [], pa.float64()).cast(pa.float32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.FixedSizeListArray.from_arrays(flat, N_FEATURES).cast(pa.list_(pa.float32()))], [*kept, "x"])

    kept = [c for c in rows.columns if c != "text"]
    return rows.mapInArrow(add, rows.drop("text").withColumn("x", F.array(F.lit(0.0).cast("float"))).schema)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, l2_words: float = 20.0, steps: int = 40, rows: int = 2048) -> np.ndarray:
    """Weights (the last is the constant) by Newton's method on standardised features; those of hashed words, which are many
    and each say little, are held closer to zero."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 1e-6
    w = np.zeros(x.shape[1] + 1)
    ridge = np.r_[np.full(N_SHAPE, l2), np.full(x.shape[1] - N_SHAPE, l2_words), 1e-6]
    for _ in range(steps):
        slope, curve = -ridge * w, np.diag(ridge)
        for i in range(0, len(x), rows):  # a part at a time, so that the driver holds little besides x
            z = np.c_[(x[i : i + rows] - mean) / scale, np.ones(len(x[i : i + rows]))]
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            slope += z.T @ (y[i : i + rows] - p)
            curve += (z * (p * (1 - p) + 1e-9)[:, None]).T @ z
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / scale, w[-1] - (w[:-1] * mean / scale).sum()]


def classify_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    host: str = "source",
    path: str = "lang",
    label: str = "quality",
    max_labels: int = 20_000,
    threshold: float = 0.5,
    columns: list[str] | None = None,
) -> DataFrame:
    """Add ``quality_evidence``, ``quality_site``, ``quality`` (probabilities) and ``kept``.

    Evidence: a logistic model on features of the whole text (its shape, hashed words and pairs of words), fitted on at most
    about ``max_labels`` labelled rows (drawn by the hash of their key; labels that are null or contradict each other take no part). Sites: every document's evidence
    is summed by host and by (host, path); the spread between hosts and between the paths of hosts gives the strength of
    the global prior and of the hosts' priors (method of moments), so sites with few documents shrink toward their host
    and hosts with few documents toward the global mean. A document's own evidence is left out of its site's and its host's. Posterior odds
    are evidence odds times site odds over global odds; ``kept`` is posterior >= ``threshold``.

    Null or empty text has features too, texts of any length are read whole. Null hosts or paths are sites of their own. Without labels of both classes there is no
    evidence: all documents get the same probability (1 without labels) and are kept. Repeated rows are scored alike; an
    empty table gives an empty result. All input columns (or ``columns``) stay, except ones named like the added ones.
    """
    made = ("quality_evidence", "quality_site", "quality", "kept")
    columns = [c for c in columns or docs.columns if c not in made]
    # The input row is one column, so its names clash with none made here.
    row = F.struct(*columns) if columns else F.struct(F.lit(0).alias("none"))
    used = docs.select(row.alias("row"), F.col(key).alias("key"), F.col(text).alias("text"), F.col(host).alias("host"), F.col(path).alias("path"))
    scored = written(with_features(used), "features")

    one = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    one = one.where("lo = hi").select(F.col(key).alias("key"), F.col("lo").cast("double").alias("y"))
    n = one.count()
    slots = 1 << 20
    drawn = one.where(F.pmod(F.xxhash64("key"), F.lit(slots)) < int(slots * min(1.0, max_labels / max(1, n))))
    train = drawn.join(scored.select("key", "x"), "key").groupBy("key", "y").agg(F.min("x").alias("x")).select("x", "y").toArrow()
    y = train["y"].to_numpy() > 0.5
    if 0 < y.sum() < len(y):
        x = np.asarray(train["x"].combine_chunks().flatten()).reshape(len(y), N_FEATURES)
        weights = fit_logistic(x, y.astype(np.float64)).tolist()
    else:
        weights = [0.0] * N_FEATURES + [30.0]

    dot = f"aggregate(zip_with(x, array({', '.join(f'{w!r}D' for w in weights[:-1])}), (a, b) -> a * b), {weights[-1]!r}D, (s, v) -> s + v)"
    evidence = F.expr(f"1D / (1D + exp(-least(greatest({dot}, -30D), 30D)))")
    scored = scored.withColumn("quality_evidence", evidence)

    # Sums by (host, path), then by host; only the global moments reach the driver.
    e = F.col("quality_evidence")
    sites = written(scored.groupBy("host", "path").agg(F.sum(e).alias("s"), F.sum(e * e).alias("q"), F.count("*").alias("n")), "sites")
    hosts = sites.groupBy("host").agg(F.sum("s").alias("hs"), F.sum("q").alias("hq"), F.sum("n").alias("hn")).withColumnRenamed("host", "own_host")
    total, count = (hosts.agg(F.sum("hs"), F.sum("hn")).first() or (None, None))[:2]
    mean = min(max((total or 0.0) / max(1, count or 0), 1e-6), 1 - 1e-6)
    inside = lambda s, q, n: F.sum(F.col(q) - F.col(s) ** 2 / F.col(n))
    spread = hosts.agg(F.sum(F.col("hn") * (F.col("hs") / F.col("hn") - mean) ** 2), inside("hs", "hq", "hn"), F.count("*")).first()
    both = sites.join(hosts, F.col("host").eqNullSafe(F.col("own_host"))).drop("own_host")
    inner = both.agg(F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col("hs") / F.col("hn")) ** 2), inside("s", "q", "n"), F.count("*")).first()

    def strength(between: float | None, within: float | None, groups: int) -> float:
        """How many documents the prior weighs: the evidence's variance inside the groups over what the groups' means vary
        beyond it."""
        noise = max((within or 0.0) / max(1, (count or 0) - groups), 0.0)
        variance = max((between or 0.0) / max(1, count or 0) - noise * groups / max(1, count or 0), 1e-6)
        return min(max(noise / variance, 1.0), 1e4)

    a, b = strength(*spread), strength(*inner)
    posterior = both.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "s", "n", "hs", "hn")
    joined = scored.join(posterior, F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")), "left")
    # A document's own evidence counts in neither its site nor its host.
    host_mean = (a * mean + F.col("hs") - e) / (a + F.col("hn") - 1)
    site = (b * host_mean + F.col("s") - e) / (b + F.col("n") - 1)
    site = F.greatest(F.least(site, F.lit(1 - 1e-6)), F.lit(1e-6))
    odds = lambda c: c / (1 - c)
    clipped = F.greatest(F.least(e, F.lit(1 - 1e-12)), F.lit(1e-12))
    o = odds(clipped) * odds(site) / odds(F.lit(mean))
    quality = o / (1 + o)
    return joined.select(*[F.col("row")[c].alias(c) for c in columns], e, site.alias("quality_site"), quality.alias("quality"), (quality >= threshold).alias("kept"))
