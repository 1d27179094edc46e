"""Token counts for a sentencepiece BPE model, with a whole-token shortcut.

No vocabulary piece holds a space mark after another character (checked when the
model is loaded), so no merge crosses from a word into the next run of spaces:
the count of a text is the sum over its pre-tokens (space run + word). Strings
that the model encodes alone as one token are found once from the vocabulary and
counted directly; only other pre-tokens are merged. Null text counts as empty.
"""
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK = re.compile(r" +[^ ]*")
_MEMO = 500_000
_models = {}


class Counts:
    def __init__(self, path):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.split = not any("▁" in p.lstrip("▁") for p in pieces)
        cand = [p.replace("▁", " ") for p in pieces if re.fullmatch("▁[^▁]+", p)]
        self.whole = {c for c, ids in zip(cand, self.sp.encode([c[1:] for c in cand], num_threads=1)) if len(ids) == 1}
        self.memo = {}

    def count(self, text):
        if not text:
            return 0
        if not self.split:
            return len(self.sp.encode(text))
        chunks = Counter(_CHUNK.findall(" " + text.replace("▁", " ")))
        total, rest = 0, []
        for c, n in chunks.items():
            if c in self.whole:
                total += n
            elif (k := self.memo.get(c)) is not None:
                total += n * k
            else:
                rest.append(c)
        if rest:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            for c, ids in zip(rest, self.sp.encode([c[1:] if c != " " else "" for c in rest], num_threads=1)):
                k = len(ids) if c != " " else 1
                total += chunks[c] * k
                if len(c) < 64:
                    self.memo[c] = k
        return total


def counter(path) -> Counts:
    if path not in _models:
        _models[path] = Counts(path)
    return _models[path]


def count_tokens(docs: DataFrame, model_path: str, limit=4096) -> DataFrame:
    """All columns of `docs`, with n_bytes, n_tokens and over_limit."""
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        c = counter(model_path)
        return pd.Series(np.array([c.count(t) for t in texts], np.int64))

    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({"n_bytes": F.octet_length(text).cast("long"), "n_tokens": run(text)})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
