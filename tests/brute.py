"""Plain sequential versions of the order-dependent operators, for small fixtures."""

import math
import re

STOP = {"a", "an", "and", "are", "as", "at", "for", "from", "in", "into", "new", "of", "on", "the", "to", "with"}


def round3(x):
    return math.floor(x * 1000 + 0.5) / 1000


def words(title):
    return [w for w in re.sub(r"[^a-z0-9一-鿿]+", " ", (title or "").lower()).split() if w not in STOP]


def sim(a, b):
    x, y = words(a), words(b)
    if not x or not y:
        return 0.0
    return 2 * sum(w in set(y) for w in x) / (len(x) + len(y))


def norm(url):
    if not url:
        return None
    m = re.match(r"^\s*([A-Za-z][\w+.-]*)://([^/?#]+)([^?#]*)", url)
    out = f"{m[1].lower()}://{m[2].lower()}{m[3] or '/'}" if m else url.strip()
    return out[:-1] if out.endswith("/") else out


def specific(url):
    return bool(url) and bool(re.match(r"^[^:/?#]+://[^/]+/+[^/]", url))


def hours(a, b):
    return None if a is None or b is None else abs((a - b).total_seconds()) / 3600


def order(articles):
    return sorted(articles, key=lambda r: (r["published_at"] or r["created_at"], r["article_id"]))


def compare(a, b):
    same_url = bool(norm(a["canonical_url"])) and norm(a["canonical_url"]) == norm(b["canonical_url"])
    same_hash = bool(a["content_hash"]) and a["content_hash"] == b["content_hash"]
    s, h = sim(a["title"], b["title"]), hours(a["published_at"], b["published_at"])
    inside = h is None or h <= 72
    diverse = a["source_id"] != b["source_id"]
    page = same_url and specific(norm(a["canonical_url"]))
    trusted = (same_hash and (diverse or page)) or (same_url and diverse) or (page and s >= 0.82)
    conf = round3(0.98 if trusted else s * (1 if inside else 0.65))
    if same_hash:
        sure = diverse or page
    elif same_url:
        sure = diverse or (round3(s) >= 0.82 and page)
    else:
        sure = diverse and conf >= 0.82
    return conf, sure


def dedupe(articles):
    rows = order(articles)
    dup, cand = {}, {}
    for i, lead in enumerate(rows):
        if lead["article_id"] in dup:
            continue
        for other in rows[i + 1 :]:
            if other["article_id"] in dup:
                continue
            conf, sure = compare(lead, other)
            if sure:
                dup[other["article_id"]] = lead["article_id"]
            elif conf >= 0.5 and other["article_id"] not in cand:
                cand[other["article_id"]] = lead["article_id"]
    return dup, cand


def cluster(articles, dup):
    """article -> first article of its cluster."""
    rows = order(articles)
    both = {(a, b) for a, b in dup.items()} | {(b, a) for a, b in dup.items()}
    label = {}

    def score(m, c):
        if (m["article_id"], c["article_id"]) in both:
            return 0.98, True
        s, h = round3(sim(m["title"], c["title"])), hours(m["published_at"], c["published_at"])
        inside = h is None or h <= 48
        diverse = m["source_id"] != c["source_id"]
        return (
            round3(min(0.94, (s + (0.06 if diverse else 0)) * (1 if inside else 0.45))),
            s >= 0.62 and inside and diverse,
        )

    for seed in rows:
        if seed["article_id"] in label:
            continue
        label[seed["article_id"]] = seed["article_id"]
        members = [seed]
        for c in rows:
            if c["article_id"] in label:
                continue
            best, take = 0, False
            for m in members:
                v, ok = score(m, c)
                if v > best:
                    best, take = v, ok
            if take:
                label[c["article_id"]] = seed["article_id"]
                members.append(c)
    return label
