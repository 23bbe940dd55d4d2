"""The greedy fold and the folds along trees, spelled out on lists: what the library's columns and kernel are held against."""

from functools import lru_cache
from unicodedata import category

Span = tuple[int, int, str]
_CLAUSE = frozenset(",;:()[]")


def consolidate(spans: list[Span], most: int | None) -> list[Span]:
    """From the left, joins each span to the last if it begins where that ends and both fit; a longer span stays whole."""
    out: list[Span] = []
    for span in spans:
        if out and out[-1][0] < span[0] and out[-1][1] == span[0] and not (most and len(out[-1][2]) + len(span[2]) > most):
            out[-1] = (out[-1][0], span[1], out[-1][2] + span[2])
        else:
            out.append(span)
    return out


@lru_cache(1 << 16)
def _kind(token: str) -> tuple[bool, bool, bool]:
    """Whether a token has a letter or digit, is a clause's mark alone, and ends a clause: has a mark in the punctuation at its end."""
    bare = token.rstrip(" ")
    end = len(bare)
    while end and category(bare[end - 1])[0] == "P":
        end -= 1
    return any(category(c)[0] in "LN" for c in bare), bare in _CLAUSE, not _CLAUSE.isdisjoint(bare[end:])


def clause_heads(tokens: list[str]) -> list[int]:
    """A stand-in for a parse: the first word of a sentence is its root, the first of each later clause hangs on it, others on their clause's."""
    kinds = [_kind(t) for t in tokens]
    root = next((i for i, k in enumerate(kinds) if k[0]), 0)
    heads, clause, fresh = [], root, False
    for i, (word, mark, ends) in enumerate(kinds):
        if i == root:
            heads.append(root)
        elif fresh and not mark:
            clause, fresh = i, False
            heads.append(root)
        else:
            heads.append(clause)
        if ends and (i > root or (i == root and word)):
            fresh = True
    return heads


def _children(heads: list[int]) -> tuple[list[list[int]], list[int]]:
    """Children of each token, and all tokens with parents before children."""
    children: list[list[int]] = [[] for _ in heads]
    order = []
    for i, h in enumerate(heads):
        if h == i:
            order.append(i)
        else:
            children[h].append(i)
    for i in order:
        order += children[i]
    return children, order


def tree_height(heads: list[int]) -> int:
    """Tokens on the longest path from the root down; 0 for no token."""
    children, order = _children(heads)
    height = [1] * len(heads)
    for i in reversed(order):
        height[i] = 1 + max((height[c] for c in children[i]), default=0)
    return max((height[i] for i, h in enumerate(heads) if h == i), default=0)


def tree_spans(tokens: list[str], heads: list[int], most: int | None) -> list[Span]:
    """Spans of a sentence, in places of tokens: each subtree is consolidated before its parent is added."""
    children, order = _children(heads)
    spans: list[list[Span]] = [[] for _ in heads]
    for i in reversed(order):
        mine = sorted([(i, i + 1, tokens[i]), *(s for c in children[i] for s in spans[c])])
        spans[i] = consolidate(mine, most)
        for c in children[i]:
            spans[c] = []
    return sorted(s for i, h in enumerate(heads) if h == i for s in spans[i])


def line_spans(sentences: list[list[str]], most: int | None, parsed: bool, heads: list[list[int]] | None = None) -> list[Span]:
    """Spans of a line, in places of its tokens. Trees are given by ``heads``, or stood in for."""
    if most and sum(len(t) for s in sentences for t in s) <= most:
        # whatever fits as a whole is joined as a whole
        return [(0, sum(map(len, sentences)), "".join(t for s in sentences for t in s))] if any(map(len, sentences)) else []
    out, base = [], 0
    for k, tokens in enumerate(sentences):
        spans = tree_spans(tokens, heads[k] if heads else clause_heads(tokens), most) if parsed else consolidate([(i, i + 1, t) for i, t in enumerate(tokens)], most)
        out += [(base + a, base + b, t) for a, b, t in spans]
        base += len(tokens)
    return consolidate(out, most)


def _end(start: int, text: str, last: str) -> int:
    """Where a span ends without the space that belongs to its last token."""
    return start + len(text) - (last.endswith(" ") and not last.isspace())


def book_spans(lines: list[list[list[str]]], most: int | None, parsed: bool, across: bool, heads: list[list[list[int]]] | None = None) -> list[Span]:
    """Spans of a book, in characters of its text."""
    out, base = [], 0
    for k, sentences in enumerate(lines):
        tokens = [t for s in sentences for t in s]
        at = base
        for _, b, text in line_spans(sentences, most, parsed, heads[k] if heads else None):
            out.append((at, _end(at, text, tokens[b - 1]), text))
            at += len(text)
        base = at
    return consolidate(out, most) if across else out
