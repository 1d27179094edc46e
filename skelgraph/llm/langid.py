"""Language identification by rank-order n-gram profiles (out-of-place distance).

Null or letterless text: ``und``, score 0. Unlabelled and null-text rows do not
teach. Ties: grams of equal count rank by code; languages of equal distance go
by name. Repeated rows count as often as they occur; extra columns are
kept, but for `lang_pred` and `score`, which are replaced.
"""
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach

PROFILE = 400
SAMPLE_ROWS = 200_000  # bound on the labelled rows that teach the profiles
MAX_LANGUAGES = 2_000
_NOT_LETTERS = regex.compile(r"\P{L}+")
_TEXTS = 256  # texts whose grams are counted together
_BLOCK = 1 << 20


def _block_grams(s: str):
    c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    space = c == 32
    out = [c[~space]]
    if len(c) > 1:
        out.append((c[:-1] << 21) | c[1:])
    if len(c) > 2:
        out.append(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[~space[1:-1]])
    return np.unique(np.concatenate(out), return_counts=True)


def grams(text):
    """(codes, counts) of all 1- to 3-grams within space-padded words of the whole text."""
    s = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not s:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = f" {s} "
    if len(s) <= _BLOCK:
        return _block_grams(s)
    keys, counts, start = [], [], 0
    while start < len(s) - 1:  # blocks end at a space, so no gram is cut
        end = s.rfind(" ", start + 1, start + _BLOCK) if start + _BLOCK < len(s) else len(s) - 1
        end = end if end > start else min(s.find(" ", start + 1), len(s) - 1)
        k, n = _block_grams(s[start:end + 1])
        keys.append(k)
        counts.append(n)
        start = end
    k, inv = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inv, weights=np.concatenate(counts)).astype(np.int64)


def top(codes, counts, size):
    return codes[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    langs: list
    codes: np.ndarray  # sorted distinct grams
    ranks: np.ndarray  # (len(codes) + 1, langs); the last row and absent grams hold `size`
    size: int = PROFILE

    def predict(self, text):
        codes, counts = grams(text)
        if not len(codes) or not self.langs:
            return "und", 0.0
        best = top(codes, counts, self.size)
        at = np.searchsorted(self.codes, best)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == best, at, len(self.codes))
        r = self.ranks[at]
        dist = np.where(r == self.size, self.size, np.abs(r - np.arange(len(best))[:, None])).sum(0)
        k = int(dist.argmin())
        return self.langs[k], float(1 - dist[k] / (self.size * len(best)))


def fit(labelled: DataFrame, size=PROFILE, sample_rows=SAMPLE_ROWS) -> Profiles:
    """Profiles from (text, lang) rows; above `sample_rows` rows, an even hash sample of about that many."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))

    def count(batches):
        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                for at in range(0, len(texts), _TEXTS):  # the grams of a whole batch at once would take some hundred megabytes
                    got = [grams(t) for t in texts.iloc[at:at + _TEXTS]]
                    k, inv = np.unique(np.concatenate([g[0] for g in got]), return_inverse=True)
                    n = np.bincount(inv, weights=np.concatenate([g[1] for g in got]), minlength=len(k))
                    yield pd.DataFrame({"lang": lang, "gram": k, "n": n.astype(np.int64)})

    ranked = (rows.mapInPandas(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
              .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
              .where(F.col("r") <= size))
    got = ranked.select("lang", "gram", "r").limit(size * MAX_LANGUAGES + 1).toPandas()
    if len(got) > size * MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs, codes = sorted(got["lang"].unique()), np.unique(got["gram"].to_numpy(np.int64))
    ranks = np.full((len(codes) + 1, len(langs)), size, np.int64)
    place = {x: i for i, x in enumerate(langs)}
    ranks[np.searchsorted(codes, got["gram"].to_numpy(np.int64)), got["lang"].map(place).to_numpy(np.int64)] = got["r"] - 1
    return Profiles(langs, codes, ranks, size)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """All columns of `docs` (which has `text`), with lang_pred and score."""
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = (StructType().add("lang_pred", StringType()).add("score", DoubleType()))

    @F.pandas_udf(schema)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    return attach(docs, predict(F.col("text")), ["lang_pred", "score"])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
