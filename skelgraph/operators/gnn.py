"""Graph embedding with given weights: message passing as edge joins with a softmax that is merged from parts.

An edge's message is weighed by the softmax, over all edges that come into its target, of a score of both ends
and the edge. A task folds its edges into (greatest score, sum of exponentials, weighted sum of
messages) for each target, one such part for each batch of its rows; parts are shifted to a common greatest score and added
after a shuffle by target, as a stream of which one row is held. So the edges of a hot target are dealt over all
tasks, only its parts meet, and no exponential overflows.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import written

STAGES = ("tag = 'HYP_DISTRICT_PATH'", "tag = 'HYP_PATH_NODE'", "tag LIKE 'TOPO%'", "NOT (tag = 'HYP_DISTRICT_PATH' OR tag = 'HYP_PATH_NODE' OR tag LIKE 'TOPO%')")


def default_weights(node_in, edge_in, hidden=128, layers=3, seed=42):
    """Weights from a rule that any engine can follow: ((7919 seed + 104729 k + 1299 i + 31 j) mod 2003 / 2003 - 0.5) times 2 sqrt(6 / (rows + columns)) for entry (i, j) of matrix k; offsets are 0."""
    count = iter(range(10 ** 6))

    def matrix(rows, columns):
        i, j = np.arange(rows)[:, None], np.arange(columns)[None, :]
        return ((7919 * seed + 104729 * next(count) + 1299 * i + 31 * j) % 2003 / 2003 - 0.5) * 2 * np.sqrt(6 / (rows + columns))

    return {"enc": matrix(node_in, hidden), "enc_b": np.zeros(hidden),
            "layers": [{"q": matrix(hidden, hidden), "k": matrix(hidden, hidden), "v": matrix(hidden, hidden), "e": matrix(edge_in, hidden), "b": np.zeros(hidden), "scale": np.ones(hidden), "shift": np.zeros(hidden)} for _ in range(layers)],
            "out1": matrix(hidden, hidden), "out1_b": np.zeros(hidden), "out2": matrix(hidden, hidden), "out2_b": np.zeros(hidden)}


def _stack(vectors):
    return np.array(vectors.tolist(), float).reshape(len(vectors), -1)


def _mapped(col, f):
    """A vector column through a function of matrices."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(f(_stack(v))), dtype=object) if len(v) else pd.Series([], dtype=object)

    return run(col)


def norm(h, scale, shift):
    return (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5) * scale + shift


def _fold(key, top, total, message):
    """One row for each run of equal keys: parts shifted to the greatest score of the run and added."""
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(1)]))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    most = np.maximum.reduceat(top, start)
    shift = np.exp(top - most[run])
    return start, most, np.add.reduceat(total * shift, start), np.add.reduceat(message * shift[:, :, None], start)


def _parts(heads, weights=None):
    """Rows (sample_id, dst, ...) folded by (sample_id, dst) within a batch: edges with their ends if `weights` are given, else parts."""
    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            if weights is not None:
                pdf = pdf.sort_values(["sample_id", "dst"], kind="stable")
                target, source, attr = (_stack(pdf[c]) for c in ("target", "source", "attr"))
                split = lambda x: x.reshape(len(x), heads, -1)
                q, k, v, e = split(target @ weights["q"]), split(source @ weights["k"]), split(source @ weights["v"]), split(attr @ weights["e"])
                score = (q * k).sum(2) + (q * e).sum(2)
                top, total, message = np.where(score > 0, score, 0.2 * score), np.ones_like(score), v
            else:
                top, total, message = _stack(pdf["top"]), _stack(pdf["total"]), _stack(pdf["message"]).reshape(len(pdf), heads, -1)
            key = np.stack([pd.factorize(pdf[c])[0] for c in ("sample_id", "dst")], axis=1)
            start, top, total, message = _fold(key, top, total, message)
            out = pdf.iloc[start][["sample_id", "dst"]]
            yield out.assign(top=list(top), total=list(total), message=list(message.reshape(len(start), -1)))
    return run


def _merged(heads):
    """Parts that come sorted by (sample_id, dst), one row for each."""
    fold = _parts(heads)

    def run(batches):
        held = None
        for pdf in batches:
            if len(pdf):
                rows = next(fold(iter([pdf if held is None else pd.concat([held, pdf])])))
                yield rows.iloc[:-1]
                held = rows.iloc[-1:]
        if held is not None:
            yield held
    return run


def attention(states: DataFrame, edges: DataFrame, weights, heads=4) -> DataFrame:
    """(sample_id, dst, out): for each target of an edge (sample_id, src, dst, attr) the weighted sum of its messages and the offset; `states` (sample_id, node_id, h)."""
    kinds = dict(states.dtypes)
    schema = f"sample_id {kinds['sample_id']}, dst {kinds['node_id']}, top array<double>, total array<double>, message array<double>"
    met = (edges.select("sample_id", "src", "dst", "attr")
           .join(states.select("sample_id", F.col("node_id").alias("src"), F.col("h").alias("source")), ["sample_id", "src"])
           .join(states.select("sample_id", F.col("node_id").alias("dst"), F.col("h").alias("target")), ["sample_id", "dst"]))
    parts = met.select("sample_id", "dst", "source", "target", "attr").mapInPandas(_parts(heads, weights), schema)
    whole = parts.repartition("sample_id", "dst").sortWithinPartitions("sample_id", "dst").mapInPandas(_merged(heads), schema)

    def ended(pdf):
        total = np.repeat(_stack(pdf["total"]), len(pdf["message"].iloc[0]) // heads, axis=1) if len(pdf) else None
        return pdf[["sample_id", "dst"]].assign(out=list(_stack(pdf["message"]) / total + weights["b"]) if len(pdf) else [])

    return whole.mapInPandas(lambda batches: (ended(pdf) for pdf in batches), f"sample_id {kinds['sample_id']}, dst {kinds['node_id']}, out array<double>")


def gnn_embed(features: DataFrame, edges: DataFrame, weights=None, hidden=128, layers=3, heads=4, staged=False, seed=42):
    """(node vectors (sample_id, node_id, vec), graph vectors (sample_id, vec)) of features (sample_id, node_id, x) and edges (sample_id, src, dst, tag, attr).

    With `staged` each layer passes the hyper, the topology and the other edges one after the other. Each layer's state is written
    once. Widths must be the same in all rows; a node without edges into it keeps its state.
    """
    if weights is None:
        first = features.select(F.size("x")).first()
        edge = edges.select(F.size("attr")).first()
        weights = default_weights(first[0] if first else 1, edge[0] if edge else 1, hidden, layers, seed)
    states = written(features.select("sample_id", "node_id", _mapped(F.col("x"), lambda x: np.maximum(x @ weights["enc"] + weights["enc_b"], 0)).alias("h")), "states")
    for layer in weights["layers"]:
        for stage in STAGES if staged else (None,):
            some = edges if stage is None else edges.where(stage)
            if stage is not None and some.isEmpty():
                continue
            got = states.join(attention(states, some, layer, heads).withColumnRenamed("dst", "node_id"), ["sample_id", "node_id"], "left")
            none = F.array(*[F.lit(float(b)) for b in layer["b"]])
            added = F.zip_with("h", F.coalesce("out", none), lambda a, b: a + b)
            states = written(got.select("sample_id", "node_id", _mapped(added, lambda h, w=layer: norm(h, w["scale"], w["shift"])).alias("h")), "states")
    from .compare import mean_pool

    pooled = mean_pool(states.select("sample_id", "node_id", F.col("h").alias("vec")))
    ends = _mapped(F.col("vec"), lambda g: np.maximum(g @ weights["out1"] + weights["out1_b"], 0) @ weights["out2"] + weights["out2_b"])
    return states.withColumnRenamed("h", "vec"), pooled.select("sample_id", ends.alias("vec"))
