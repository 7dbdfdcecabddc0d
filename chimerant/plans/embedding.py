"""Protein models as plug-ins: from vectors of residues to a vector of a sequence.

A model takes a batch of sequences and returns an array (sequence, place, component) of the last layer, with a place in front
of the residues and one behind; places after a shorter sequence's own may hold anything. What a model gives is pooled here:

* exact: the mean over a sequence's own residues, whatever else is in its batch. Index windows are pooled so.
* padded: the mean over all places but the first and the last, of the longest sequence of the batch. Published searches pool
  their queries so, which makes a vector depend on its batch; kept for parity only.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext

Model = Callable[[list[str]], np.ndarray]
Embedder = Callable[[list[str]], np.ndarray]


def plugin(spec: str) -> Callable:
    """What `module:function` names."""
    module, _, name = spec.partition(":")
    if not name:
        raise ValueError(f"{spec}: expected module:function")
    return getattr(importlib.import_module(module), name)


class Pooled:
    """An embedder of a model that `spec` (module:function) makes; each worker process makes it once, when it first needs it.

    gpus: so many devices of a machine are dealt to its tasks in turn."""

    def __init__(self, spec: str | Callable[[], Model], exact: bool = True, gpus: int | None = None):
        self.spec, self.exact, self.gpus, self.model = spec, exact, gpus, None

    def __getstate__(self):
        return {"spec": self.spec, "exact": self.exact, "gpus": self.gpus, "model": None}

    def __call__(self, sequences: list[str]) -> np.ndarray:
        if self.model is None:
            if self.gpus and (task := TaskContext.get()):
                os.environ["CUDA_VISIBLE_DEVICES"] = str(task.partitionId() % self.gpus)
            self.model = (plugin(self.spec) if isinstance(self.spec, str) else self.spec)()
        plain = [s.replace(" ", "") for s in sequences]
        places = np.asarray(self.model(plain), np.float32)
        longest = max(map(len, plain), default=0)
        if places.ndim != 3 or places.shape[:2] != (len(plain), longest + 2):
            raise ValueError(f"the model gave {places.shape} for {len(plain)} sequences of {longest} residues at most")
        if not self.exact:
            return places[:, 1:-1].mean(1) if longest else np.zeros((len(plain), places.shape[2]), np.float32)
        out = np.zeros((len(plain), places.shape[2]), np.float32)
        for i, s in enumerate(plain):
            if s:
                out[i] = places[i, 1 : 1 + len(s)].mean(0)
        return out


def width(embedder: Embedder) -> int:
    """Components of the embedder's vectors."""
    return int(np.asarray(embedder(["MKV"])).shape[1])
