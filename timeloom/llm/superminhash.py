"""SuperMinHash signatures of many element sets at once.

Every element draws a random permutation of the signature's places, one place per round;
in round ``j`` it offers the value ``j + u`` (u uniform in [0, 1)) to the place it draws,
and a place keeps its least offer. Offers of one element are spread evenly over the places,
which makes the estimate's variance lower than with independent draws. Since a later round
offers only larger values, a place that has a value after a round is final, and a set is
done with the first round after which none of its places is empty: long sets stop after one
or two rounds, and only short ones go on.
"""

from __future__ import annotations

import numpy as np

from timeloom.llm.words import mix

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Elements whose permutations are in memory at once (one byte for each place).
BLOCK = 1 << 16


def _draws(elements: np.ndarray, round_: int) -> np.ndarray:
    return mix(elements + np.uint64((0xD1B54A32D192ED03 * (round_ + 1)) & 0xFFFFFFFFFFFFFFFF))


def signatures(elements: np.ndarray, bounds: np.ndarray, places: int) -> np.ndarray:
    """One row of ``places`` values per set; set ``i`` is ``elements[bounds[i]:bounds[i+1]]``.

    ``elements`` are 64-bit hashes; repeats change nothing. Two sets agree at a place with a
    probability that is their Jaccard similarity. The row of an empty set is all ones.
    A value's first bits are the round, its others the draw.
    """
    n_sets = len(bounds) - 1
    out = np.full((n_sets, places), _EMPTY, np.uint64)
    first = 0
    while first < n_sets:
        last = int(np.searchsorted(bounds, bounds[first] + BLOCK, "right")) - 1
        last = min(max(last, first + 1), n_sets)
        part = slice(int(bounds[first]), int(bounds[last]))
        owner = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
        _rounds(elements[part], owner, out, places)
        first = last
    return out


def _rounds(elements: np.ndarray, owner: np.ndarray, out: np.ndarray, places: int) -> None:
    flat, permutation = out.reshape(-1), None
    for round_ in range(places):
        if not len(elements):
            return
        draw = _draws(elements, round_)
        # The low half picks the place, the high half is the offer; they are independent.
        pick = round_ + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - round_)) >> np.uint64(32)).astype(np.int64)
        if permutation is None:
            place = pick
        else:
            rows = np.arange(len(elements))
            place = permutation[rows, pick].astype(np.int64)
            permutation[rows, pick] = permutation[:, round_]
        at = owner * places + place
        open_ = (flat[at] >> np.uint64(56)) >= np.uint64(min(round_, 254))
        offers = (draw >> np.uint64(8)) | np.uint64(min(round_, 254) << 56)
        np.minimum.at(flat, at[open_], offers[open_])
        unfinished = (out[np.unique(owner)] == _EMPTY).any(axis=1)
        still = np.zeros(len(out), bool)
        still[np.unique(owner)] = unfinished
        go_on = still[owner]
        if permutation is None:
            elements, owner = elements[go_on], owner[go_on]
            # Round 0 swapped place 0 with the pick; later rounds go on from there.
            permutation = np.tile(np.arange(places, dtype=np.uint8), (len(elements), 1))
            permutation[np.arange(len(elements)), pick[go_on]] = 0
        elif not go_on.all():
            elements, owner, permutation = elements[go_on], owner[go_on], permutation[go_on]


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band: a hash of the band's number and its values."""
    n, places = signature.shape
    rows = signature.reshape(n, bands, places // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(rows.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key
