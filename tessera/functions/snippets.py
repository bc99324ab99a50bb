"""The part of a text that shows best what a query hit: a window of tokens with hits marked."""

from __future__ import annotations

from .stemming import term, word_spans

FIRST_HIT, REPEAT, TEXT_START, SENTENCE_START = 1000, 1, 120, 100


def _sentence_starts(text: str, spans: list[tuple[int, int]]) -> list[int]:
    """Tokens that begin the text or follow a full stop or colon and white space."""
    out = []
    for i, (start, _) in enumerate(spans):
        before = text[:start].rstrip(" \t\n\r") if i else ""
        if i == 0 or before[-1:] in (".", ":"):
            out.append(i)
    return out


def snippet(text: str, terms: list[str], width: int = 32, open_: str = "<b>", close: str = "</b>", cut: str = "...") -> str:
    """``terms``: stemmed. A window's score counts terms it has, then their repeats, and a bonus at a sentence's start."""
    spans = word_spans(text)
    wanted = set(terms)
    hits = [(i, t) for i, (a, b) in enumerate(spans) if (t := term(text[a:b])) in wanted]
    best, best_score = 0, 0

    def scored(start: int) -> tuple[int, int]:
        """The score from ``start`` on, and the window's start with its hits in the middle."""
        seen, score, first, last = set(), 0, -1, -1
        for i, t in hits:
            if start <= i < start + width:
                score += REPEAT if t in seen else FIRST_HIT
                seen.add(t)
                first, last = (i if first < 0 else first), i + 1
        middle = first - (width - (last - first)) // 2
        return score, max(0, min(middle, len(spans) - width))

    starts = _sentence_starts(text, spans)
    for i, _ in hits:
        score, middle = scored(i)
        if score > best_score:
            best, best_score = middle, score
        sentence = max((s for s in starts if s <= i), default=0)
        if sentence < i and len(spans) > width:
            score = scored(sentence)[0] + (TEXT_START if sentence == 0 else SENTENCE_START)
            if score > best_score:
                best, best_score = sentence, score
    if not spans:
        return text
    end = min(best + width, len(spans))
    marked = {i for i, _ in hits}
    out, at = ([cut], spans[best][0]) if best else ([], 0)
    i = best
    while i < end:
        a = spans[i][0]
        out.append(text[at:a])
        if i in marked:
            out += [open_, text[a : spans[i][1]], close]
        else:
            out.append(text[a : spans[i][1]])
        at = spans[i][1]
        i += 1
    out.append(text[at:] if end == len(spans) else cut)
    return "".join(out)
