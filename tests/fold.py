"""A plain sequential fold over ordered events, to hold the parallel operators against.

Events are dicts with t (µs), s, service (or None), err (bool), trace (or None).
"""

from collections import defaultdict


def fold_anomalies(events, span, multiplier):
    seen, flagged = defaultdict(list), set()
    for e in events:
        if not e["err"]:
            continue
        times = seen[e["service"] or ""]
        times.append(e["t"])
        inside = [x for x in times if x > e["t"] - span]
        older = sum(1 for x in inside if x < e["t"] - span // 2)
        recent = len(inside) - older
        if len(inside) >= 10 and older >= 5 and recent >= older * multiplier:
            flagged.add((e["t"], e["s"]))
    return flagged


def fold_cascades(events, window):
    """{(t, s): (origin, is_new)}"""
    bursts, traces, known, out = {}, defaultdict(dict), set(), {}
    for e in events:
        me = e["service"]
        if not me:
            continue
        if me in bursts and e["t"] - bursts[me]["last"] > window:
            del bursts[me]
        if not e["err"]:
            continue
        mine = bursts.setdefault(me, {"onset": (e["t"], e["s"]), "last": e["t"]})
        mine["last"] = e["t"]
        origin = None
        if e["trace"]:
            first = traces[e["trace"]]
            first.setdefault(me, (e["t"], e["s"]))
            others = sorted((p, name) for name, p in first.items() if name != me)
            if others and 0 <= mine["onset"][0] - others[0][0][0] <= window:
                origin = others[0][1]
        else:
            others = sorted(
                (b["onset"], name)
                for name, b in bursts.items()
                if name != me and 0 <= mine["onset"][0] - b["onset"][0] <= window
            )
            if others:
                origin = others[0][1]
        if origin:
            out[(e["t"], e["s"])] = (origin, (origin, me) not in known)
            known.add((origin, me))
    return out


def fold_silence(events, span, threshold):
    """{(service, t, s): (older, recent)}"""
    times, flagged, out = defaultdict(list), set(), {}
    if not events:
        return out
    active = events[0]["t"] + span
    for e in events:
        t = e["t"]
        if e["service"]:
            times[e["service"]].append(t)
            flagged.discard(e["service"])
        if t < active:
            continue
        for name, ts in times.items():
            older = sum(1 for x in ts if t - span <= x < t - span // 2)
            recent = sum(1 for x in ts if x >= t - span // 2)
            if older < 5 or name in flagged:
                continue
            half = span / 60e6 / 2
            if (1 - (recent / half) / (older / half)) * 100 >= threshold:
                flagged.add(name)
                out[(name, t, e["s"])] = (older, recent)
    return out


def fold_chains(edges):
    """The chain printed at each new (origin, service) pair, in order."""
    chain, out = [], []
    for origin, service in edges:
        chain = chain + [service] if chain and chain[-1] == origin else [origin, service]
        out.append(list(chain))
    return out
