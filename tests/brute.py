"""Single-row models in plain Python, for tests only."""

import regex as re  # its word characters include marks, as they should
import unicodedata

from textguard import rules

INVISIBLE = {c for lo, hi in rules.INVISIBLE_RANGES for c in range(lo, hi + 1)}


def normalize(text):
    kept = "".join(c for c in text if ord(c) not in INVISIBLE)
    folded = "".join(c.lower() for c in unicodedata.normalize("NFKC", kept))
    return " ".join(folded.split())


def luhn(text):
    digits = [int(c) for c in text if c in "0123456789"]
    if not 13 <= len(digits) <= 19:
        return False
    twice = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def spans(text):
    found = []
    for ord_, kind, pattern in rules.DETECTORS:
        for m in re.finditer(pattern, text):
            if kind != rules.LUHN_KIND or luhn(m.group()):
                found.append((m.start(), ord_, m.end(), kind))
    merged = []
    for start, _ord, end, kind in sorted(found):
        if merged and start < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]), merged[-1][2])
        else:
            merged.append((start, end, kind))
    return merged


def redact(text):
    out, last = "", 0
    for start, end, kind in spans(text):
        out += text[last:start] + rules.MASKS[kind]
        last = end
    return out + text[last:]


def keywords(norm):
    """Earliest-ending phrase first, without overlaps."""
    hits, at = [], 0
    phrases = rules.all_phrases()
    while True:
        ends = [(norm.find(p, at) + len(p), p) for p in phrases if norm.find(p, at) >= 0]
        if not ends:
            return hits
        end, phrase = min(ends, key=lambda e: (e[0], -len(e[1])))
        hits.append((phrase, end - len(phrase), end))
        at = end


def first_attack(text):
    found = keywords(normalize(text))
    if found:
        return "prompt_injection", "keyword:" + found[0][0]
    if re.search(rules.BASE64_PATTERN, text):
        return "malicious_payload", rules.BASE64_RULE
    if re.search("(?i)" + rules.FAKE_TURN_PATTERN, text):
        return "jailbreak", rules.FAKE_TURN_RULE
    return None


def run_stream(deltas, window=rules.STREAM_WINDOW):
    """Index of the delta that ends the stream and why, or None."""
    tail = ""
    for i, delta in enumerate(deltas):
        if not delta:
            continue
        scan = tail + delta
        if any(rules.KIND_CATEGORY[k] == rules.SECRET_LEAK for _s, _e, k in spans(scan)):
            return i, rules.SECRET_LEAK
        attack = first_attack(scan)
        if attack:
            return i, attack[0]
        tail = scan[-window:]
    return None


def rate_limit(times, limit, window):
    accepted, out = [], []
    for t in times:
        ok = sum(t - a < window for a in accepted) < limit
        if ok:
            accepted.append(t)
        out.append(ok)
    return out
