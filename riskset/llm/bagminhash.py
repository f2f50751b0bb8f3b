"""BagMinHash signatures of multisets.

The weight axis is cut into octaves [0, 1), [1, 2), [2, 4), [4, 8), ...; every element carries one Poisson process
per octave its weight reaches, with rate proportional to the octave's width, whose points have a register, a time and
a weight inside the octave. A point counts if its weight lies below the element's. A register's value is the earliest
time of its points. Points depend on the element alone, so two multisets agree in a register with probability equal to
their weighted Jaccard similarity, exactly for whole-number weights. Processes are followed only until their next
point comes later than every register's value, which makes the work per multiset n + m log m, not n times m; an
element of weight w costs log w processes, not w.
"""

from __future__ import annotations

import numpy as np

from riskset.llm.common import U64, mix

REGISTERS = 128
_STEP, _OCTAVE, _INSIDE = U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03), U64(0x8CB92BA72F3D8DD7)
_UNIT = 2.0 ** -53


def signatures(hashes: np.ndarray, weights: np.ndarray, sizes: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Signatures (rows of ``m`` 64-bit values) of multisets laid end to end.

    ``hashes`` and ``weights`` hold the elements of all multisets, ``sizes`` how many each has. ``m`` is a power of
    two. An empty multiset has the bits of infinity everywhere.
    """
    if m & (m - 1) or not 1 < m <= 1024:
        raise ValueError("m must be a power of two up to 1024")
    low = U64(m - 1)
    best = np.full(len(sizes) * m, np.inf)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    seed, doc, width, room = [mix(hashes ^ _OCTAVE)], [owner], [np.ones(len(hashes))], [np.full(len(hashes), np.inf)]
    octave = 1
    many = np.flatnonzero(weights > 1)
    while len(many):
        start = 2.0 ** (octave - 1)
        seed.append(mix(hashes[many] ^ U64((int(_OCTAVE) * (octave + 1)) & (2 ** 64 - 1))))
        doc.append(owner[many])
        width.append(np.full(len(many), start))
        # the octave is the weight range [start, 2 start); what the weight leaves out is thinned away
        inside = weights[many] - start
        room.append(np.where(inside >= start, np.inf, inside))
        octave += 1
        many = many[weights[many] > 2.0 ** (octave - 1)]
    seed, doc, width, room = (np.concatenate(x) for x in (seed, doc, width, room))
    time = np.zeros(len(seed))
    bound = np.full(len(sizes), np.inf)
    step = 0
    while len(seed):
        draw = mix(seed + U64((step * int(_STEP)) & (2 ** 64 - 1)))
        time -= np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * _UNIT) / (m * width)
        at = doc * m + (draw & low).astype(np.int64)
        partly = np.isfinite(room)
        if partly.any():
            held = ~partly
            spot = (mix(draw[partly] ^ _INSIDE) >> U64(11)).astype(np.float64) * _UNIT * width[partly]
            held[partly] = spot < room[partly]
            np.minimum.at(best, at[held], time[held])
        else:
            np.minimum.at(best, at, time)
        step += 1
        if step < 8 or step % 8 == 0:
            if step < 8:
                bound = best.reshape(-1, m).max(axis=1)
            else:
                live = np.unique(doc)
                bound[live] = best.reshape(-1, m)[live].max(axis=1)
        on = time < bound[doc]
        if not on.all():
            seed, doc, width, room, time = seed[on], doc[on], width[on], room[on], time[on]
    return best.view(U64).reshape(-1, m)


def fingerprints(signature: np.ndarray) -> np.ndarray:
    """16 bits of every register: different values agree with probability 2**-16."""
    return (mix(signature) >> U64(48)).astype(np.uint16)
