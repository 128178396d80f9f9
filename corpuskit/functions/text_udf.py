"""Arrow UDFs for the few cleaning steps Spark has no expression for."""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpuskit.functions.runs import periodic_stretches

# --- Fixed values: code points with the Unicode property Emoji (emoji-data, version 16) ---
# digits, "#" and "*" have it too, but are emoji in key caps only
EMOJI_RANGES = """
a9 ae 203c 2049 2122 2139 2194-2199 21a9-21aa 231a-231b 2328 23cf 23e9-23f3 23f8-23fa 24c2 25aa-25ab 25b6 25c0 25fb-25fe
2600-2604 260e 2611 2614-2615 2618 261d 2620 2622-2623 2626 262a 262e-262f 2638-263a 2640 2642 2648-2653 265f-2660 2663
2665-2666 2668 267b 267e-267f 2692-2697 2699 269b-269c 26a0-26a1 26a7 26aa-26ab 26b0-26b1 26bd-26be 26c4-26c5 26c8
26ce-26cf 26d1 26d3-26d4 26e9-26ea 26f0-26f5 26f7-26fa 26fd 2702 2705 2708-270d 270f 2712 2714 2716 271d 2721 2728
2733-2734 2744 2747 274c 274e 2753-2755 2757 2763-2764 2795-2797 27a1 27b0 27bf 2934-2935 2b05-2b07 2b1b-2b1c 2b50 2b55
3030 303d 3297 3299 1f004 1f0cf 1f170-1f171 1f17e-1f17f 1f18e 1f191-1f19a 1f1e6-1f1ff 1f201-1f202 1f21a 1f22f
1f232-1f23a 1f250-1f251 1f300-1f321 1f324-1f393 1f396-1f397 1f399-1f39b 1f39e-1f3f0 1f3f3-1f3f5 1f3f7-1f4fd 1f4ff-1f53d
1f549-1f54e 1f550-1f567 1f56f-1f570 1f573-1f57a 1f587 1f58a-1f58d 1f590 1f595-1f596 1f5a4-1f5a5 1f5a8 1f5b1-1f5b2 1f5bc
1f5c2-1f5c4 1f5d1-1f5d3 1f5dc-1f5de 1f5e1 1f5e3 1f5e8 1f5ef 1f5f3 1f5fa-1f64f 1f680-1f6c5 1f6cb-1f6d2 1f6d5-1f6d7
1f6dc-1f6e5 1f6e9 1f6eb-1f6ec 1f6f0 1f6f3-1f6fc 1f7e0-1f7eb 1f7f0 1f90c-1f93a 1f93c-1f945 1f947-1f9ff 1fa70-1fa7c
1fa80-1fa89 1fa8f-1fac6 1face-1fadc 1fadf-1fae9 1faf0-1faf8
"""
SKIN_TONES = ["light", "medium-light", "medium", "medium-dark", "dark"]  # U+1F3FB to U+1F3FF
# ------------------------------------------------------------------------------
VARIATION_SELECTOR, JOINER, KEY_CAP = "\ufe0f", "\u200d", "\u20e3"
FIRST_LETTER, FIRST_TONE = 0x1F1E6, 0x1F3FB
TAGS, FIRST_TAG, LAST_TAG, END_TAG = 0xE0000, 0xE0020, 0xE007E, 0xE007F  # invisible copies of ASCII behind a flag
BLACK_FLAG = "\U0001f3f4"
SLICE = 256  # rows of an Arrow batch that are Python strings at a time


def emoji_code_points() -> list[int]:
    codes = []
    for part in EMOJI_RANGES.split():
        first, _, last = part.partition("-")
        codes += range(int(first, 16), int(last or first, 16) + 1)
    return codes


def default_emoji_names() -> dict:
    """Single emoji to name, derived from the Unicode character names."""
    names = {}
    for code in emoji_code_points():
        name = unicodedata.name(chr(code), "")
        if name and not FIRST_LETTER <= code < FIRST_LETTER + 26:
            names[chr(code)] = name.lower().replace(" ", "_")
    names |= {chr(FIRST_TONE + i): f"{tone}_skin_tone" for i, tone in enumerate(SKIN_TONES)}
    return names


def _default_replacer():
    """Names of whole sequences: flags, subdivision flags, key caps, skin tones and joined emoji, the longest first."""
    names = default_emoji_names()
    tone = f"[{chr(FIRST_TONE)}-{chr(FIRST_TONE + 4)}]"
    tags = f"(?:[{chr(FIRST_TAG)}-{chr(LAST_TAG)}]+{chr(END_TAG)})"
    one = f"{_char_class(list(names))}{VARIATION_SELECTOR}?{tone}?{tags}?"
    letter = f"[{chr(FIRST_LETTER)}-{chr(FIRST_LETTER + 25)}]"
    pattern = re.compile(f"{letter}{letter}|[0-9#*]{VARIATION_SELECTOR}?{KEY_CAP}|{one}(?:{JOINER}{one})*")

    def name(match):
        found = match.group()
        if found[-1] == KEY_CAP:
            return f":keycap_{found[0]}:"
        if FIRST_LETTER <= ord(found[0]) < FIRST_LETTER + 26:
            return ":flag_" + "".join(chr(ord("a") + ord(c) - FIRST_LETTER) for c in found) + ":"
        place = "".join(chr(ord(c) - TAGS) for c in found if FIRST_TAG <= ord(c) <= LAST_TAG)
        if place and found[0] == BLACK_FLAG:
            return f":flag_{place[:2]}_{place[2:]}:" if len(place) > 2 else f":flag_{place}:"
        return ":" + "_".join([names[c] for c in found if c in names] + [place] * bool(place)) + ":"

    some = re.compile("[\xa9\xae\u203c-\U0010ffff]")  # every emoji and the key cap; two ranges are a fast search
    return lambda text: pattern.sub(name, text) if some.search(text) else text


def _char_class(chars: list[str]) -> str:
    """A regex set of the characters, written as ranges of neighbours."""
    ranges = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]"


def emoji_replacer(names: dict | None):
    if names is None:
        return _default_replacer()
    if not names:
        return lambda text: text
    sequences = sorted((k for k in names if len(k) > 1), key=len, reverse=True)
    parts = list(map(re.escape, sequences))
    singles = [k for k in names if len(k) == 1]
    parts += [_char_class(singles)] if singles else []
    # the look-ahead dismisses ordinary characters with very few comparisons
    low = {k[0] for k in names if k[0] < "\u2000"}
    start = f"(?=[{''.join(map(re.escape, sorted(low)))}\u2000-\U0010ffff])"
    pattern = re.compile(start + "(" + "|".join(parts) + ")" + VARIATION_SELECTOR + "?")
    return lambda text: pattern.sub(lambda m: f":{names[m.group(1)]}:", text)


def first_sentences(text: str) -> str:
    kept = {}
    for sentence in re.split(r"(?<=[.!?]) +", text):
        kept.setdefault(sentence.lower(), sentence)
    return " ".join(kept.values())


def reduce_repetitions(text: str) -> str:
    """Three or more equal characters in a row become two (never newlines)."""
    if len(text) < 3:
        return text
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    same = codes[1:] == codes[:-1]
    return re.sub(r"(.)\1{2,}", r"\1\1", text) if (same[1:] & same[:-1]).any() else text


def _fold(text: str) -> str:
    """Lower case per character, so offsets stay those of ``text``."""
    lower = text.lower()
    if len(lower) == len(text) and "\u03a3" not in text:
        return lower
    return "".join(char.lower()[0] for char in text)


def _periodic_starts(words: list[str], repeats: int) -> list[tuple[int, int, int]]:
    """(first, last, period): word positions where a unit of ``period`` words may repeat.

    A unit of m words that occurs ``repeats + 1`` times gives a stretch of at least ``repeats * m - 2``
    positions k with word[k] == word[k + m]: its first and last words may match in part only.
    """
    count = len(words)
    if count < 4:
        return []
    codes = {word: code for code, word in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(codes.__getitem__, words), np.int64, count)
    found = [(begin, end, 2) for begin, end in _stretches(ids[:-2] == ids[2:]) if end - begin >= 2 * repeats - 2]
    # a longer unit gives a run of places whose four words occur again soon; only such places are searched
    pairs = ids[:-1] * len(codes) + ids[1:]
    if len(codes) >= 1 << 15:
        pairs = np.unique(pairs, return_inverse=True)[1]
    fours = pairs[:-2] * (int(pairs.max()) + 1) + pairs[2:]
    ordered = np.sort(fours)
    open_runs = []
    if (ordered[1:] == ordered[:-1]).any():
        order = np.argsort(fours, kind="stable")
        again = np.flatnonzero(fours[order[1:]] == fours[order[:-1]])
        distance = np.full(len(fours), count)
        distance[order[again]] = order[again + 1] - order[again]
        open_runs = _stretches(distance < count)
    while open_runs:
        begin, end = open_runs.pop()
        longest = (end - begin + 5) // repeats  # a period m makes at least repeats * m - 5 such places in a row
        soon = distance[begin:end] <= longest
        if soon.all():
            window = ids[begin : end + 3 + longest]
            found += [(a + begin, b + begin, m) for a, b, m in _window_stretches(window, longest, repeats)]
        else:
            open_runs += [(a + begin, b + begin) for a, b in _stretches(soon)]
    starts = set()
    for begin, end, period in found:
        first, last = max(begin - 1, 0), min(end - repeats * period + 1, count - (repeats + 1) * period)
        if first <= last:
            starts.add((first, last, period))
    return sorted(starts)


def _stretches(true: np.ndarray) -> list[tuple[int, int]]:
    """(first, last + 1) of every maximal run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], true, [False])).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _window_stretches(ids: np.ndarray, longest: int, repeats: int) -> list:
    """The periodic stretches of periods from 3 on; few short periods are compared one by one."""
    if longest > 32:
        return periodic_stretches(ids, 3, repeats, 2).tolist()
    found = []
    for period in range(3, min(longest, len(ids) - 1) + 1):
        same = ids[:-period] == ids[period:]
        if np.count_nonzero(same) >= repeats * period - 2:
            found += [(a, b, period) for a, b in _stretches(same) if b - a >= repeats * period - 2]
    return found


def collapse_chunks(text: str, max_repeats: int = 2) -> str:
    """Same result as two passes of ``(.+?)(?:\\s+\\1){n,}`` -> first group, ignoring case.

    The backtracking regex needs quadratic time and more; this scan finds the repetitions of the
    word sequence in O(n log n) (see ``runs``), because a repeated unit must end where a word ends and its second
    copy must begin where a word begins.
    """
    if not text:
        return ""
    pattern = re.compile(r"(.+?)(?:\s+\1){%d,}" % max_repeats, re.IGNORECASE)
    for _ in range(2):
        before = text
        if max_repeats < 2:
            text = pattern.sub(r"\1", text)
        else:
            text = _collapse_once(text, max_repeats, pattern)
        if text == before:
            break
    return text


def _collapse_once(text: str, repeats: int, pattern) -> str:
    folded = _fold(text)
    words = folded.split()
    count = len(words)
    upcoming = _periodic_starts(words, repeats)[::-1]
    copied = [k for k, (a, b, c) in enumerate(zip(words, words[1:], words[repeats:])) if a.endswith(b) and c.startswith(b)]
    if not upcoming and not copied and not re.search(r"\s{%d}" % (2 * repeats + 1), text):
        return text  # no word at which a unit may begin
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    active: list[tuple[int, int]] = []  # (period, last start)
    begins = [a for a, _ in spans] + [len(text)]
    next_begin = {end: begins[k + 1] for k, (_, end) in enumerate(spans)}
    out, position = [], 0

    def match_end(start, end, lead):
        """End of the whole repetition of folded[start:end], or -1."""
        unit = folded[start:end]
        if "\n" in unit:
            return -1
        times, at = 0, end
        while at in next_begin:
            follow = next_begin[at] - lead
            if follow <= at or not folded.startswith(unit, follow):
                break
            at = follow + len(unit)
            times += 1
        return at if times >= repeats else -1

    def lead_limit(k, period):
        """Most white space before word k that can belong to the unit."""
        floor = max(position, spans[k - 1][1] if k else 0)
        gap = text[floor : spans[k][0]]
        size = len(gap) - (gap.rfind("\n") + 1)
        for copy in range(1, repeats + 1):
            word = k + copy * period
            before = folded[spans[word - 1][1] : spans[word][0]]
            size = min(size, len(before) - 1)
            while size > 0 and before[-size:] != gap[-size:]:
                size -= 1
        return max(size, 0)

    def candidates(k):
        if k + repeats < count and words[k].endswith(words[k + 1]) and words[k + repeats].startswith(words[k + 1]):
            yield 1
        for period, last in active:
            if k <= last and words[k].endswith(words[k + period]):
                yield period

    def best_unit(k):
        """(start, unit end, match end) of the leftmost, then shortest unit that begins by word k."""
        best = None
        for period in candidates(k):
            end = spans[k + period - 1][1]
            start = spans[k][1] - len(words[k + period])
            lead = lead_limit(k, period) if start == spans[k][0] else 0
            for begin in range(start - lead, start + 1):
                if begin < position:
                    continue
                if best and begin >= best[0]:
                    break
                stop = match_end(begin, end, start - begin)
                if stop >= 0:
                    best = (begin, end, stop)
                    break
        return best

    # words by which a unit may begin; every other word is copied as it is
    may_begin = np.zeros(count + 1, dtype=bool)
    may_begin[copied] = True
    for first, last, _ in upcoming:
        may_begin[first : last + 1] = True
    ends = [0] + [b for _, b in spans]
    may_begin[[k for k, (a, b) in enumerate(zip(ends, begins)) if b - a > 2 * repeats]] = True

    for k in np.flatnonzero(may_begin).tolist():
        if k < count and spans[k][1] <= position:
            continue
        while upcoming and upcoming[-1][0] <= k:
            _, last, period = upcoming.pop()
            active.append((period, last))
        active = sorted(item for item in active if item[1] >= k)
        searching = True
        while searching:
            floor = max(position, spans[k - 1][1] if k else 0)
            roomy = begins[k] - floor > 2 * repeats
            blank = pattern.search(text, floor, begins[k]) if roomy else None
            best = best_unit(k) if k < count else None
            searching = bool(blank) and (best is None or blank.start() <= best[0])
            if searching:
                out += [text[position : blank.start()], blank.group(1)]
                position = blank.end()
        if best:
            out.append(text[position : best[1]])
            position = best[2]
    out.append(text[position:])
    return "".join(out)


def arrow_steps(
    names: list[str], emoji_names: dict | None = None, max_repeats: int = 2, once: bool = False
):
    """One Arrow UDF that runs the named steps in order; null stays null.

    An Arrow batch may hold 64 MB, and a string four times its bytes, so a batch goes through Python in slices and
    every slice is handed back before the next one.  ``once`` keeps Catalyst from copying an expensive run of steps into a filter
    on its result and thereby evaluating it twice.
    """

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = {
            "emoji": emoji_replacer(emoji_names) if "emoji" in names else None,
            "lower": str.lower,
            "chunks": lambda text: collapse_chunks(text, max_repeats),
            "sentences": first_sentences,
            "repetitions": reduce_repetitions,
            "nfc": lambda text: unicodedata.normalize("NFC", text),
        }
        steps = [table[name] for name in names]

        def one(text):
            for step in steps:
                text = step(text)
            return text

        for batch in batches:
            for start in range(0, len(batch), SLICE):
                part = batch.slice(start, SLICE).to_pylist()
                yield pa.array([None if text is None else one(text) for text in part], pa.string())

    return run.asNondeterministic() if once else run
