"""Ids of many strings, kept in Arrow memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Strings that a store keeps at most, and bytes of one that is kept.
KEEP, LONG = 800_000, 256


class Store:
    """Strings with their ids, in Arrow memory.  ``make`` gives the ids, one string after another, and their numbers.

    When there are over ``KEEP`` strings, those that were asked for last stay, so frequent ones do; one of over ``LONG``
    bytes is forgotten at once.
    """

    def __init__(self, make, dtype):
        self.make, self.clock = make, 0
        self.names, self.ids = pa.array([], pa.string()), np.empty(0, dtype)
        self.offsets, self.used = np.zeros(1, np.int64), np.empty(0, np.int64)

    def of(self, coded: pa.DictionaryArray) -> pa.ListArray:
        """The ids of each entry."""
        names, self.clock = coded.dictionary, self.clock + 1
        rows = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int32)
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = np.arange(len(new)) + len(self.names)
            fresh = names.take(pa.array(new))
            ids, numbers = self.make(fresh)
            self.names = pa.concat_arrays([self.names, fresh])
            self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(numbers)])
            self.ids = np.concatenate([self.ids, ids])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[rows] = self.clock
        out = self._lists().take(pa.array(rows[coded.indices.to_numpy()]))
        if len(new) and (long := pc.binary_length(self.names).to_numpy() > LONG).any():
            self._keep(~long)
        if len(self.names) > KEEP:
            cut = np.partition(self.used, -(KEEP // 2))[-(KEEP // 2)]
            self._keep(self.used >= cut if (self.used >= cut).sum() <= KEEP else self.used > cut)
        return out

    def _lists(self) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(self.offsets.astype(np.int32)), pa.array(self.ids))

    def _keep(self, stay: np.ndarray) -> None:
        rows = pa.array(np.flatnonzero(stay))
        lists = self._lists().take(rows)
        self.names, self.used = self.names.take(rows), self.used[stay]
        self.ids, self.offsets = lists.flatten().to_numpy().copy(), lists.offsets.to_numpy().astype(np.int64)
