"""Plain re-statements of what the operators have to return, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def shingles(text: str | None, k: int) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def jaccard_components(docs: dict[int, str | None], k: int, num: int, den: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def top(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    inverted, seen = defaultdict(list), {}
    for i in sorted(sets):
        for j, n in Counter(j for s in sets[i] for j in inverted[s]).items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
        if sets[i] and sets[i] not in seen:
            seen[sets[i]] = i
            for s in sets[i]:
                inverted[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in docs}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def pii_base(text: str) -> list[tuple[int, int, int]]:
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m)) <= 15]
    return sorted(out)


def secret_base(text: str) -> list[tuple[int, int, int]]:
    name = r"[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    out = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({name})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


CONTROL = ["<|turn|>", "<|end|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


def escaped(text: str) -> str:
    out, i = "", 0
    while i < len(text):
        found = next((c for c in CONTROL if text.startswith(c, i)), None)
        if text[i] == "\\":
            out += "\\\\"
        elif found:
            out += found[0] + "\\" + found[1:]
            i += len(found) - 1
        else:
            out += text[i]
        i += 1
    return out


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """A conversation in the template, and where its assistant texts are."""
    out, spans = "", []
    for role, text in turns:
        out += "<|turn|>" + escaped(role).replace("\n", "\\n") + "\n"
        if role == "assistant":
            spans.append((len(out), len(out) + len(escaped(text))))
        out += escaped(text) + "<|end|>\n"
    return out, spans


def chats(rows: list[tuple[int | None, int | None, str | None, str | None]]) -> dict[int, tuple]:
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [(x[3], x[5]) for x in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted(turns)[0]))
    return out
