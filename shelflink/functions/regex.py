"""Regular-expression helpers shared by every text function.

The engine's texts are mostly CJK, so two Java regex defaults are wrong for it:
``\\s`` only knows ASCII blanks and ``\\b`` treats ideographs as word characters.
``rx`` rewrites a pattern so that both follow the Unicode-blank / ASCII-word
meaning the title rules are written for.  Patterns are plain driver-side strings;
the rewritten text goes into built-in ``rlike`` / ``regexp_*`` expressions.
"""

from __future__ import annotations

from functools import lru_cache

# Fixed value: the characters that count as blanks in page text.
BLANKS = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
ASCII_WORD = "A-Za-z0-9_"
WORD_EDGE = f"(?:(?<![{ASCII_WORD}])(?=[{ASCII_WORD}])|(?<=[{ASCII_WORD}])(?![{ASCII_WORD}]))"


@lru_cache(maxsize=512)
def rx(pattern: str, ignore_case: bool = False) -> str:
    out = ["(?i)"] if ignore_case else []
    in_class = False
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        pair = pattern[i : i + 2]
        if pair == r"\s":
            out.append(BLANKS if in_class else f"[{BLANKS}]")
        elif pair == r"\S":
            out.append(f"[^{BLANKS}]")
        elif pair == r"\b" and not in_class:
            out.append(WORD_EDGE)
        elif ch == "\\":
            out.append(pair)
        else:
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "[":
                out.append("\\")
            elif ch == "]":
                in_class = False
            out.append(ch)
            i += 1
            continue
        i += 2
    return "".join(out)
