"""Sequential, one-row-at-a-time forms of the jobs, for small random data (ASCII text)."""

import re


def meaning_key(t):
    return re.sub(r"[!?,.]", "", re.sub(r"\s+", "", t.lower()))


def grams(k):
    return {k[i:i + 2] for i in range(len(k) - 1)}


def similarity(a, b):
    a, b = meaning_key(a), meaning_key(b)
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (c != d))
    return row[-1]


def key(surface, reading):
    s, r = (surface or "").replace(" ", ""), reading.replace(" ", "")
    return f"surface:{s}\0reading:{r}" if s else f"reading:{r}"


def decide(word, rows):
    surface = (word["kanji"] or "").replace(" ", "")
    mine = key(word["kanji"], word["kana"])
    for r in rows:
        if (r["canonical_key"] or key(r["kanji"], r["kana"])) == mine:
            return "exact", r["id"], None
    same = [r for r in rows if r["kana"] == word["kana"]]
    if len(same) == 1 and (not surface or not same[0]["kanji"]) and similarity(
            word["burmese_meaning"], same[0]["burmese_meaning"]) >= 0.45:
        return "enrich", same[0]["id"], None
    best = None
    for r in rows:
        if not surface or (r["kanji"] or "").replace(" ", "") != surface:
            continue
        d, s = distance(word["kana"], r["kana"]), similarity(word["burmese_meaning"], r["burmese_meaning"])
        if d > 1 or s < 0.45:
            continue
        score = round(0.55 + 0.25 * (d == 0) + 0.2 * s + 1e-12, 3)
        if best is None or score > best[2]:
            best = ("review", r["id"], score)
    return best or ("new", None, None)


def ingest(words, rows):
    """Decisions of a batch in order; inserted words are visible to later ones."""
    rows, seen, out = list(rows), set(), {}
    top = max([r["id"] for r in rows], default=0)
    for w in sorted(words, key=lambda w: w["position"]):
        k = key(w["kanji"], w["kana"])
        if k in seen:
            continue
        seen.add(k)
        kind, target, score = decide(w, rows)
        out[w["position"]] = (kind, target, score)
        if kind == "new":
            rows.append({**w, "id": top + 1 + w["position"], "canonical_key": k})
    return out


def corrections(revision, submissions):
    out = []
    for position, base in sorted(submissions):
        ok = base == revision
        revision += ok
        out.append((position, "accepted" if ok else "stale", revision))
    return out


def sm2(grades):
    ease, interval, reps, status = 2.5, 0, 0, "learning"
    for g in grades:
        if g < 3:
            reps, interval, status = 0, 0, "learning"
        else:
            reps += 1
            interval = 1 if reps == 1 else 6 if reps == 2 else int(interval * round(ease, 2) + 0.5 + 1e-9)
            status = "mastered" if interval >= 21 else "reviewing"
        ease = max(1.3, ease + 0.1 - (5 - g) * (0.08 + (5 - g) * 0.02))
    return round(ease, 6), interval, reps, status
