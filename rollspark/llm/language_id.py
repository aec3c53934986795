"""Language identification by mixtures of languages over hashed character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod

BUCKETS = 1 << 14
SLICES = 16
LOTS = 256


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point, itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    found = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()], np.uint32)
    table[found] = found
    return table


def grams(text: str | None) -> np.ndarray:
    """Hashed trigrams of a whole text in lower case, runs of other characters than letters taken as one space.

    Empty if there is no letter.
    """
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = _letters()[points]
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    if len(points) < 3:
        return np.empty(0, np.int64)
    mixed = points[:-2] * np.uint32(2654435761) + points[1:-1] * np.uint32(2246822519) + points[2:] * np.uint32(3266489917)
    mixed ^= mixed >> np.uint32(15)
    return ((mixed * np.uint32(668265263)) >> np.uint32(18)).astype(np.int64)


def count_grams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, slice, counts (little-endian 64-bit): the n-gram counts of all texts of each language.

    Tasks' sums are added in ``LOTS`` lots before they meet, so no group holds a row of every task.
    """

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                own += np.bincount(grams(t), minlength=BUCKETS)
        for name, own in sums.items():
            cut = [x.tobytes() for x in np.split(own, SLICES)]
            lot = TaskContext.get().partitionId() % LOTS
            yield pa.RecordBatch.from_arrays([pa.array([name] * SLICES), pa.array(range(SLICES), pa.int32()), pa.array(cut, pa.binary()), pa.array([lot] * SLICES, pa.int32())], ["lang", "slice", "counts", "lot"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BUCKETS // SLICES, np.int64)
        for x in frame["counts"]:
            total += np.frombuffer(x, np.int64)
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "slice": frame["slice"].iloc[:1], "counts": [total.tobytes()]})

    schema = "lang string, slice int, counts binary"
    return docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(count, f"{schema}, lot int").groupBy("lang", "slice", "lot").applyInPandas(add, schema).groupBy("lang", "slice").applyInPandas(add, schema)


def mixture(counts: np.ndarray, loglik: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of the languages and the log-likelihood, by expectation-maximisation. loglik: languages x n-grams."""
    top = loglik.max(0)
    p = np.exp(loglik - top)
    share = np.full(len(p), 1 / len(p))
    weight = counts / counts.sum()
    for _ in range(steps):
        joint = share[:, None] * p
        share = share * (p @ (weight / joint.sum(0)))
    return share, float(counts @ (np.log(share @ p) + top))


def languages_of(hashed: np.ndarray, logp: np.ndarray, prior: np.ndarray, steps: int = 12, penalty: float = 4.0) -> tuple[np.ndarray, np.ndarray] | None:
    """The selected languages (indices, largest share first) and their shares; None if the text has no n-gram.

    Sets are grown by share in the mixture of all languages; a set's likelihood is penalised by ``penalty`` times the log
    of the number of n-grams for each language beyond the first. ``prior``, the log of the languages' shares of what was
    learned, decides the single language of very short texts.
    """
    if not len(hashed):
        return None
    full = np.bincount(hashed, minlength=BUCKETS)
    seen = np.flatnonzero(full)
    counts, loglik = full[seen].astype(np.float64), logp[:, seen]
    share, _ = mixture(counts, loglik, steps) if len(logp) > 1 else (np.ones(1), 0.0)
    order = np.argsort(-share, kind="stable")
    single = loglik @ counts
    first = int((single + prior).argmax())
    best, chosen = float(single[first]), (np.array([first]), np.ones(1))
    price = penalty * np.log(max(2, len(hashed)))
    for size in range(2, len(order) + 1):
        if share[order[size - 1]] < 0.01:
            break
        some, value = mixture(counts, loglik[order[:size]], steps)
        if value - price * (size - 1) <= best:
            break
        by = np.argsort(-some, kind="stable")
        best, chosen = value - price * (size - 1), (order[:size][by], some[by])
    return chosen


def identify_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", held: int = 2, of: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the language in the document), langs (the selected set) and shares.

    N-gram models are learned from all documents with text and language whose crc32 of the key as text modulo ``of`` is not
    ``held``; predictions use the whole text alone. Text that is null or has no letter: ``und``, score 0. If nothing was
    learned, all are ``und``. Ties between languages go to the first by name. Texts of any length are read whole; repeated rows
    are predicted alike; other columns take no part; an empty table gives an empty result. The models that reach the driver and the tasks
    hold 128 KB a language; ``lang`` is taken to name languages, so their number does not grow with the rows.
    """
    out = crc_mod(key, of) == held
    learned = count_grams(docs.where(~out), text, lang).collect()
    names = sorted({r["lang"] for r in learned})
    counts = np.zeros((len(names), BUCKETS))
    for r in learned:
        width = BUCKETS // SLICES
        counts[names.index(r["lang"]), r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    logp = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)) if names else counts
    prior = np.log((counts.sum(1) + 1) / (counts.sum() + len(names))) if names else counts
    shared = docs.sparkSession.sparkContext.broadcast((logp, prior))

    def predict(batches):
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                found = languages_of(grams(t), *shared.value) if names else None
                rows.append((found[0].tolist(), found[1].tolist()) if found else ([], []))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([names[i[0]] if i else "und" for i, _ in rows], pa.string()),
                    pa.array([min(1.0, max(0.0, s[0])) if s else 0.0 for _, s in rows], pa.float64()),
                    pa.array([[names[k] for k in i] for i, _ in rows], pa.list_(pa.string())),
                    pa.array([s for _, s in rows], pa.list_(pa.float64())),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "langs", "shares"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(text, F.col(key).alias("doc_id"), out.alias("held_out")).mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, langs array<string>, shares array<double>")
