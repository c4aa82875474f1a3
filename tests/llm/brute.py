"""Plain one-machine versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(nodes, linked):
    """node -> least node reachable, for ``linked(a, b)`` over all pairs."""
    left, out = sorted(nodes), {}
    while left:
        group, todo = [], [left.pop(0)]
        while todo:
            a = todo.pop()
            group.append(a)
            near = [b for b in left if linked(a, b)]
            left = [b for b in left if b not in near]
            todo += near
        out.update(dict.fromkeys(group, min(group)))
    return out


def fingerprint(text):
    w = SPACE_WORD.findall(lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def contamination(docs, items):
    own = defaultdict(set)
    for item, text in items:
        w = TOKEN.findall(lower(text))
        for i in range(max(len(w) - 13, 0) + 1 if w else 0):
            own[tuple(w[i : i + 13])].update([] if item is None else [str(item)])
    out = {}
    for doc_id, text in docs:
        w = TOKEN.findall(lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in own}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in own:
                    hit.update(range(p, p + n))
                    found |= own[tuple(w[p : p + n])]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w))
    return out


def quality_base(text):
    w = SPACE_WORD.findall(text or "")
    triples = Counter(zip(w, w[1:], w[2:]))
    covered = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if triples[t] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if SPACE_WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered)


def repeats(rows, match=100):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - match + 1):
            s = b[p : p + match]
            if s in seen:
                gone[p : p + match] = b"\1" * match
            seen.add(s)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[doc_id] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def audit(symbols):
    """(cost, audit) by trying every sequence of edits; upper case is truncated, x has to go."""
    roles = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = None
    todo = [(0, "", 0, "")]  # cost, audit, rows done, last initial
    while todo:
        cost, edits, done, last = todo.pop()
        if best and cost > best[0] or edits.count("I") > 4:
            continue
        if done == len(symbols) and last in ("", "a"):
            best = min(best or (cost, edits), (cost, edits))
        needs = "a" if last == "u" else "u"
        todo.append((cost + 3, edits + "I", done, needs))
        if done < len(symbols):
            x = symbols[done]
            todo.append((cost + 4, edits + "D", done + 1, last))
            if x != "x":
                extra = 3 * x.isupper()
                todo.append((cost + 3 + extra, edits + "R", done + 1, needs))
                if x.lower() in roles[last]:
                    todo.append((cost + extra, edits + "K", done + 1, x.lower()))
    return best


def conversations(rows):
    """conv_id -> summary, cost, audit and digest of damaged rows (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        word = lambda v: " " if v is None else v
        role, text, own = word(role), word(text), groups[conv]
        kind = zlib.crc32(f"{word(conv)}:{word(turn)}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, own in groups.items():
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts, symbols, seen = Counter(), "", set()
        for _, role, text in own:
            shown = text.strip(" \t\n\v\f\r")
            fault = "b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            initial = role[:1] if role[:1] in tuple("sua") else "o"
            symbols += "x" if fault in tuple("bd") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, edits = audit(symbols)
        lines, left, last = [], iter(own), ""
        for e in edits:
            row = next(left) if e != "I" else (None, None, "")
            if e != "D":
                role = row[1] if e == "K" else "assistant" if last == "u" else "user"
                last = role[0]
                lines.append(f"{role}:{row[2]}")
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, edits, digest)
    return out


def hard_negatives(rows):
    """Sorted (anchor, positive, rank, negative, scores) of rows (vec_id, embedding, label)."""
    fit = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        fit.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    out = []
    for k, (anchor, own, v) in enumerate(fit):
        if anchor is None or anchor % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i is None, i or 0, label == own) for j, (i, label, w) in enumerate(fit) if j != k]
        scored.sort()
        for p, no_id, positive, _ in [s for s in scored if s[3]][:5]:
            inside = [s for s in scored if not s[3] and 50 * -p <= 100 * -s[0] <= 95 * -p]
            for rank, (n, missing, negative, _) in enumerate(inside[:3], 1):
                out.append((anchor, None if no_id else positive, rank, None if missing else negative, -p, -n))
    return sorted(out, key=repr)
