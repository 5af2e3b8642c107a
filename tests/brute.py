"""Plain Python versions of the snapshot operators."""

import re
from collections import defaultdict
from urllib.parse import urlsplit


def key(url):
    u = urlsplit(url.strip())
    host = re.sub(r"^www\.", "", u.netloc.lower())
    q = "&".join(p for p in u.query.split("&") if p and not re.match(r"^(utm_[a-z]+|ref|src|gclid|fbclid)(=.*)?$", p))
    return host + u.path.rstrip("/") + ("?" + q if q else "")


def weeks(snapshots, calendar):
    """source -> list of (k, {page: price}) in order of k."""
    best = {}
    seen = set()
    for r in snapshots.itertuples():
        for c in calendar.itertuples():
            if c.week_start <= r.last_seen < c.week_end:
                seen.add((r.source, c.load_no))
                price = None if r.price != r.price or r.price is None else int(r.price)
                at = (r.source, c.load_no, key(r.url))
                rank = (r.last_seen, r.load_no, -1 if price is None else price)
                if at not in best or rank > best[at][0]:
                    best[at] = (rank, price)
    out = defaultdict(dict)
    for s, k in sorted(seen):
        out[s][k] = {}
    for (s, k, p), (_, price) in best.items():
        out[s][k][p] = price
    return {s: sorted(x.items()) for s, x in out.items()}


def changes(by):
    found = set()
    for snaps in by.values():
        for (_, a), (k, b) in zip(snaps, snaps[1:]):
            found |= {(k, p, "added") for p in b if p not in a} | {(k, p, "removed") for p in a if p not in b}
            found |= {(k, p, "changed") for p in b if p in a and a[p] != b[p]}
    return found


def versions(by):
    found = []
    for snaps in by.values():
        running = {}
        for k, held in snaps:
            for p in [p for p in running if p not in held]:
                found.append((p, *running.pop(p)))
            for p, price in held.items():
                if p in running and (price is None or running[p][0] == price):
                    running[p][2] = k
                else:
                    if p in running:
                        found.append((p, *running.pop(p)))
                    if price is not None:
                        running[p] = [price, k, k]
        found += [(p, *v) for p, v in running.items()]
    return found
