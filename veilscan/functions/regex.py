"""Patterns: Python notation in, the equivalent Java pattern for Spark out.

Rules are written the way Python users write them. Java's regex engine differs
in four places that change results, so each is spelled out explicitly:

* word characters and ``\\b`` (Java 17 and later releases disagree on both),
* ``\\d`` (Java: ASCII only), ``\\s`` (Java: ASCII only),
* case-insensitive A-Z, which in Python also covers four non-ASCII letters.
"""

from __future__ import annotations


def _ranges(codes: list[int]) -> str:
    """A character class body with runs of neighbours written as ranges."""
    runs: list[list[int]] = []
    for code in codes:
        if runs and runs[-1][1] == code - 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs)


# What Python's \\s matches, as the body of a Java character class.
SPACE = _ranges([i for i in range(0x3001) if chr(i).isspace()])
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
# The letters that match [a-z] when Python ignores case.
LETTER = r"A-Za-z\u0130\u0131\u017F\u212A"

# Java steps back by whole characters only if it sees one beyond U+FFFF in the pattern
# itself; this letter (U+10330) is a word character already and adds nothing else.
WORD_BEFORE = WORD + "\U00010330"

NOT_AFTER_WORD = f"(?<![{WORD_BEFORE}])"
NOT_BEFORE_WORD = f"(?![{WORD}])"
BOUNDARY = f"(?:(?<=[{WORD_BEFORE}])(?![{WORD}])|(?<![{WORD_BEFORE}])(?=[{WORD}]))"

_CLASSES = {"d": DIGIT, "s": SPACE, "w": WORD}


def to_java(pattern: str, opens: str | None = None) -> str:
    """Translate a case-insensitive Python pattern.

    ``opens`` is a character class body naming every character a match can start
    with. If all of these are word characters the leading ``\\b`` shrinks to "not
    after a word character"; if letters are not among them, the engine rejects a
    position on one character test before it looks behind.
    """
    out: list[str] = []
    in_class = False
    class_start = 0
    literal_letters = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            if n == "u":
                out.append(pattern[i : i + 6])
                i += 6
                continue
            if n == "b" and not in_class:
                out.append(_boundary(pattern, i, opens))
            elif n in _CLASSES:
                out.append(_CLASSES[n] if in_class else f"[{_CLASSES[n]}]")
            elif n in "DSWBAZ":
                raise ValueError(f"\\{n} has no translation; use an explicit class")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class and pattern[i : i + 3] in ("A-Z", "a-z"):
            if LETTER not in out[class_start:]:
                out.append(LETTER)
            i += 3
            continue
        if c == "[" and not in_class:
            in_class = True
            class_start = len(out)
        elif c == "]" and in_class:
            in_class = False
        elif in_class and c in "&[":
            c = "\\" + c
        elif c.isalpha():
            literal_letters = True
        out.append(c)
        i += 1
    body = "".join(out)
    if opens and "A-Z" not in opens:  # pays for rare characters only
        body = f"(?=[{to_java(f'[{opens}]')[1:-1]}])" + body
    return "(?iu)" + body if literal_letters else body


def _boundary(pattern: str, at: int, opens: str | None) -> str:
    if at == 0 and opens:
        others = [p for p in _parts(opens) if p not in ("\\d", "A-Z", "_")]
        if not others:
            return NOT_AFTER_WORD
        # Inside a word, which is where most positions are, one look behind is enough.
        return f"(?:{NOT_AFTER_WORD}(?=[{WORD}])|(?=[{''.join(others)}])(?<=[{WORD_BEFORE}]))"
    # A pattern that ends in \b after a digit, a letter class or a counted repeat of
    # one needs only the look-ahead: the character before it is a word character.
    if at + 2 == len(pattern) and _ends_in_word(pattern[:at]):
        return NOT_BEFORE_WORD
    return BOUNDARY


def _parts(body: str) -> list[str]:
    parts, i = [], 0
    while i < len(body):
        step = 2 if body[i] == "\\" else 3 if body[i + 1 : i + 2] == "-" else 1
        part = body[i : i + step]
        parts.append("\\d" if part[0].isdigit() and part[-1].isdigit() else part)
        i += step
    return parts


def _ends_in_word(head: str) -> bool:
    if head.endswith("}"):
        count = head[head.rindex("{") + 1 : -1].split(",")[0]
        if not count.isdigit() or int(count) < 1:
            return False
        head = head[: head.rindex("{")]
    return head.endswith(("\\d", "[A-Za-z]", "[A-Z0-9]", "[A-Za-z0-9]"))

