"""Row-by-row models of the policies for small inputs, written independently of the library.

Rows are ``(t, key)`` in arrival order.
"""

from __future__ import annotations

import math


def sessions(rows, gap, inclusive, fire, alive, accept, pre_merge, progress="before", is_data=None, moves=None):
    """Final sessions ``{(first, last, key): count}`` and the arrival numbers that were dropped.

    ``fire`` is not needed for the final content. ``alive`` and ``accept`` are distances from
    ``last + gap`` to the progress value that removes a session / rejects a row.
    """
    wm = -math.inf
    live = []  # [first, last, key, members]
    done = []
    dropped = []
    for number, (t, key) in enumerate(rows):
        # removal happens when progress is made, i.e. before the next row is looked at
        for s in [s for s in live if wm >= s[1] + gap + alive]:
            live.remove(s)
            done.append(s)
        if is_data is None or is_data(key):
            touching = [
                s for s in live
                if s[2] == key
                and (t - s[1] <= gap if inclusive else t - s[1] < gap)
                and (s[0] - t <= gap if inclusive else s[0] - t < gap)
            ]
            last = t if pre_merge else max([t] + [s[1] for s in touching])
            if wm >= last + gap + accept:
                dropped.append(number)
            else:
                for s in touching:
                    live.remove(s)
                live.append([
                    min([t] + [s[0] for s in touching]),
                    max([t] + [s[1] for s in touching]),
                    key,
                    1 + sum(s[3] for s in touching),
                ])
        if moves is None or moves(key):
            wm = max(wm, t)
    result = {}
    for first, last, key, n in done + live:
        result.setdefault((first, last, key), []).append(n)
    return {k: sorted(v) for k, v in result.items()}, dropped


def sliding(rows, size, slide, accept, min_start=None):
    """Final counts ``{(start, key): n}`` and dropped (arrival, start) pairs, ``accept`` from the end."""
    wm = -math.inf
    counts, dropped = {}, []
    for number, (t, key) in enumerate(rows):
        start = t // slide * slide
        while start + size > t:
            if min_start is None or start >= min_start:
                if wm >= start + size + accept:
                    dropped.append((number, start))
                else:
                    counts[(start, key)] = counts.get((start, key), 0) + 1
            start -= slide
        wm = max(wm, t)
    return counts, dropped


def panes(rows, size, slide, fire, accept, early_every):
    """Every report ``(start, key, kind, count)`` of accumulating panes, flushed at the end."""
    wm = -math.inf
    state, out = {}, []

    def advance(to):
        for (start, key), s in state.items():
            if not s["fired"] and to >= start + size + fire:
                s["fired"] = True
                if s["n"]:
                    out.append((start, key, "on_time", s["n"]))

    for t, key in rows:
        start = t // slide * slide
        while start + size > t:
            if wm < start + size + accept:
                s = state.setdefault((start, key), {"n": 0, "fired": wm >= start + size + fire})
                s["n"] += 1
                if s["fired"]:
                    out.append((start, key, "late", s["n"]))
                elif early_every and s["n"] % early_every == 0:
                    out.append((start, key, "early", s["n"]))
            start -= slide
        wm = max(wm, t)
        advance(wm)
    advance(math.inf)
    return sorted(out)


def session_panes(rows, gap, inclusive, fire, alive, accept, repeat=False, is_data=None, moves=None, flush=True, early=None):
    """Every report ``(kind, first, last, key, count)`` of growing sessions. ``early``: whenever a merged count passes more
    multiples of it than the counts before."""
    wm = -math.inf
    live, out = [], []  # [first, last, key, count, fired]

    def report(s, kind):
        out.append((kind, s[0], s[1], s[2], s[3]))

    def advance(to):
        for s in list(live):
            if to >= s[1] + gap + fire and (repeat or not s[4]):
                report(s, "repeat" if s[4] else "on_time")
                s[4] = True
            if to >= s[1] + gap + alive:
                live.remove(s)

    for t, key in rows:
        if is_data is None or is_data(key):
            near = [
                s for s in live
                if s[2] == key and (abs_gap(s, t) <= gap if inclusive else abs_gap(s, t) < gap)
            ]
            last = max([t] + [s[1] for s in near])
            if wm < last + gap + accept:
                for s in near:
                    live.remove(s)
                merged = [min([t] + [s[0] for s in near]), last, key, 1 + sum(s[3] for s in near),
                          any(s[4] for s in near)]
                live.append(merged)
                if merged[4] or (not repeat and wm >= last + gap + fire):
                    merged[4] = True
                    report(merged, "late")
                elif early and merged[3] // early > sum(s[3] // early for s in near):
                    report(merged, "early")
        if (moves is None or moves(key)) and t > wm:
            wm = t
            advance(wm)
    if flush:
        for s in live:
            if not s[4]:
                report(s, "on_time")
    return sorted(out)


def abs_gap(s, t):
    """Distance of ``t`` from the session's rows."""
    return max(s[0] - t, t - s[1], 0)


def count_windows(rows, size, slide, keyed):
    seen, out = {}, []
    for t, key in rows:
        group = key if keyed else None
        items = seen.setdefault(group, [])
        items.append(t)
        if len(items) % slide == 0:
            last = items[-size:]
            out.append((group, len(items), min(last), max(last), len(last)))
    return sorted(out)
