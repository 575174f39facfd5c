"""Plain statements of the rules, one row at a time, to compare the table jobs with."""

import re
import unicodedata
from difflib import SequenceMatcher


def fingerprint(text):
    folded = unicodedata.normalize("NFKD", (text or "").strip().lower())
    kept = "".join(c for c in folded if not unicodedata.combining(c))
    return " ".join(sorted({w for w in re.split(r"[^\w]+", kept) if w}))


def grams(text, n=2):
    reduced = re.sub("[^a-z0-9]", "", (text or "").lower())
    if not text:
        return frozenset()
    return frozenset([reduced]) if len(reduced) < n else frozenset(reduced[i : i + n] for i in range(len(reduced) - n + 1))


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def ratio(a, b):
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def leaders(values, near):
    """value -> leader, taking the values in order."""
    lead = {}
    for i, v in enumerate(values):
        if v in lead:
            continue
        lead[v] = v
        for w in values[i + 1 :]:
            if w not in lead and near(v, w):
                lead[w] = v
    return lead


def is_blank(v):
    return v is None or not v.strip() or v.lower() == "nan"


def normalized(values, threshold=0.85):
    """value -> canonical form of a generic column."""
    kept = [v.strip() for v in values if not is_blank(v)]
    order = list(dict.fromkeys(kept))
    if len(order) <= 1:
        return {v: v for v in order}
    groups = {}
    for v in order:
        groups.setdefault(fingerprint(v), []).append(v)
    lead = leaders(list(groups), lambda a, b: jaccard(grams(a), grams(b)) >= threshold)
    clusters = {}
    for key, members in groups.items():
        clusters.setdefault(lead[key], []).extend(members)
    out = {}
    for members in clusters.values():
        best = max(members, key=lambda v: (kept.count(v), v == v.lower(), -len(v), -members.index(v))).lower()
        out.update(dict.fromkeys(members, best))
    return out


def described(noun, text, brand, modifier, attributes):
    if is_blank(noun):
        return (text or "").lower()
    parts = [noun.lower()]
    if not is_blank(modifier):
        parts += [m.strip() for m in modifier.lower().split(",") if m.strip()]
    if not is_blank(brand):
        parts.append(brand.lower())
    for a in attributes:
        if not is_blank(a) and a.lower() not in parts:
            parts.append(a.lower())
    if len(parts) < 3 and text:
        common = {"the", "a", "an", "and", "or", "for", "to", "of", "in", "on", "at", "by", "with"}
        words = [w.strip(".,;:()[]{}\"'-") for w in text.lower().split()]
        for w in [w for w in words if len(w) > 3 and w not in common and w not in parts][:3]:
            if w not in parts:
                parts.append(w)
    return parts[0] + " - " + " ; ".join(parts[1:]) if len(parts) > 1 else parts[0]


def chosen_category(ai_confidence, ai_mapped, ai_proposed, web_confidence, web_mapped, web_proposed):
    for found, category, method in (
        (web_confidence == "high", web_mapped, "Web"),
        (ai_confidence in ("high", "medium"), ai_mapped, "AI"),
        (True, web_mapped, "Web"),
    ):
        if found and category:
            return category, "", method
    proposed = ai_proposed or web_proposed or "UNCATEGORIZED"
    return "", proposed, "No Match" if proposed == "UNCATEGORIZED" else "Proposed"
