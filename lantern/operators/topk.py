"""The k best rows of each query among those that a task has seen."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Best:
    """Rows are scored by blocks against all queries; only the k best of each query stay, ties by the smaller key.

    Scores are compared at `digits` decimals, like the ranking over all tasks, which needs no more than this keeps."""

    def __init__(self, queries: int, k: int, highest: bool, digits: int = 9):
        self.k, self.sign, self.digits = k, -1.0 if highest else 1.0, digits
        self.edge = np.full(queries, np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.size, self.most = 0, 4 * k * queries + (1 << 15)

    def add(self, scores: np.ndarray, keys: pa.Array, eligible: np.ndarray | None = None, exact=None, slack: float = 0.0) -> None:
        """scores: (queries, rows). eligible: which of them count. exact: a function of queries and rows that gives the
        scores to keep, where those given are only within `slack` of them."""
        cost = scores * self.sign
        if eligible is not None:
            cost = np.where(eligible, cost, np.inf)
        margin = 10.0**-self.digits
        if cost.shape[1] > self.k:
            edge = np.minimum(self.edge, np.partition(cost, self.k - 1, axis=1)[:, self.k - 1])
        else:
            edge = self.edge
        bound = np.where(np.isfinite(edge), edge + 2 * slack + 2 * margin * (1 + np.abs(np.where(np.isfinite(edge), edge, 0))), np.finfo(float).max)
        q, row = np.nonzero(cost <= bound[:, None])
        if not len(q):
            return
        kept = scores[q, row] if exact is None else exact(q, row)
        self.held.append((q.astype(np.int32), kept, keys.take(pa.array(row))))
        self.size += len(q)
        if self.size > self.most:
            self._cut()

    def _cut(self) -> None:
        q, score = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        keys = pa.concat_arrays([x[2] for x in self.held])
        parts = keys.flatten() if pa.types.is_struct(keys.type) else [keys]
        columns = {"q": pa.array(q), "s": pa.array(np.round(score, self.digits) * self.sign)} | {f"k{i}": x for i, x in enumerate(parts)}
        order = pc.sort_indices(pa.table(columns), sort_keys=[(c, "ascending") for c in columns]).to_numpy()
        q, score = q[order], score[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        own = rank < self.k
        last = rank == self.k - 1
        self.edge[q[last]] = score[last] * self.sign
        self.held, self.size = [(q[own], score[own], keys.take(pa.array(order[own])))], int(own.sum())

    def rows(self) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
        """(query, score, key) of what is left."""
        if not self.held:
            return None
        self._cut()
        return self.held[0]
