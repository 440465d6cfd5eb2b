"""Removal of windows that also start earlier: the part word and byte dedup share.

Both operators first find candidate windows by their own method. Here every
candidate's fingerprint is compared over the corpus in packed form, and all
but the first occurrence, in order of (document, position), are marked.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from .exchange import split_by
from .packed import pack, unpack

FORWARD = np.uint8(1)


def send_windows(hashes: np.ndarray, at: np.ndarray, buckets: int, forward: Iterable[tuple[int, bytes]] = ()) -> Iterable[tuple[int, bytes]]:
    """First of each fingerprint in the group, with its place; forward payloads ride along."""
    _, first = np.unique(hashes, return_index=True)
    first.sort()
    h, p = hashes[first], at[first].astype(np.uint32)
    for b, idx in enumerate(split_by(h, buckets)):
        if len(idx):
            yield b, pack(np.zeros(1, np.uint8), h[idx], p[idx])
    for b, payload in forward:
        yield b, pack(np.full(1, FORWARD), np.frombuffer(payload, np.uint8))


def answer_windows(groups: np.ndarray, payloads: list[bytes]) -> Iterable[tuple[int, bytes]]:
    """Back to each group: the places whose fingerprint an earlier group holds."""
    plain = []
    for g, raw in zip(groups, payloads, strict=True):
        parts = unpack(raw)
        if parts[0][0] == FORWARD:
            yield int(g), pack(parts[0], parts[1])
        else:
            plain.append((int(g), parts[1], parts[2]))
    if not plain:
        return
    h = np.concatenate([x[1] for x in plain])
    order = np.argsort(h, kind="stable")  # groups ascend, so the first of a run is the earliest
    later = np.zeros(len(h), bool)
    later[order[1:]] = h[order[1:]] == h[order[:-1]]
    at = 0
    for g, own, place in plain:
        if (lost := later[at : at + len(own)]).any():
            yield g, pack(np.zeros(1, np.uint8), place[lost])
        at += len(own)


def later_windows(hashes: np.ndarray, at: np.ndarray, got: Iterable[np.ndarray]) -> np.ndarray:
    """Of a group's candidate windows, the places of those that aren't first in the corpus.

    A window is later if its fingerprint came before in its own group, or the
    answers name the place of the fingerprint's first occurrence in the group.
    """
    if not len(hashes):
        return at
    _, first, of = np.unique(hashes, return_index=True, return_inverse=True)
    told = list(got)
    lost = np.isin(at[first], np.concatenate(told)) if told else np.zeros(len(first), bool)
    is_first = np.zeros(len(hashes), bool)
    is_first[first] = True
    return at[~is_first | lost[of]]
