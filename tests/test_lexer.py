"""Comments found in blocks against a scanner that reads a text once."""

import random

import pytest

from marlstone.operators import lexer


def one_pass(text):
    """As the rules read: a code point at a time."""
    out, line, i, state = [], 1, 0, "code"
    while i < len(text):
        two = text[i : i + 2]
        if state == "code":
            if two == "//":
                end = text.find("\n", i)
                end = len(text) if end < 0 else end
                out.append((line, text[i:end]))
                i = end
                continue
            if two == "/*":
                end = text.find("*/", i + 2)
                end = len(text) if end < 0 else end + 2
                out.append((line, text[i:end]))
                line += text.count("\n", i, end)
                i = end
                continue
            state = {'"': '"', "'": "'"}.get(text[i], "code")
            line += text[i] == "\n"
            i += 1
        elif text[i] == "\\":
            i += 2
        else:
            line += text[i] == "\n"
            state = "code" if text[i] == state else state
            i += 1
    return out


CASES = ["", "a // b\n// c", "/* a\nb */ x // y", '"// no" // yes', "'\"' // yes", '"\\"// no" /**/', "/*/ x */ //", "/***/ a/ /b", "a / / b /", "/* open\nto the end", '"open // no', "'\\\n' // two", "//", "/", "/*", '/"/*"*/', "中 // 文\n/*😀*/"]


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1 << 16])
def test_comments_against_one_pass(spark, block):
    r = random.Random(block)
    texts = CASES + ["".join(r.choices("/*\"'\\\nab", k=r.randrange(60))) for _ in range(150)] + ["//x\n" * 3_000 if block > 1 else "//x\n" * 40]
    rows = list(enumerate(texts)) + [(None, "/* k */"), (9_999, None)]
    got = {}
    for x in lexer.comments(spark.createDataFrame(rows, "id long, t string"), "id", "t", block).collect():
        got.setdefault(x["id"], []).append((x["line"], x["comment"]))
    for i, t in rows:
        assert sorted(got.get(i, [])) == sorted(one_pass(t or "")), (t, block)


def test_maps_compose():
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choices("/*\"'\\\nab", k=r.randrange(12))) for _ in range(2))
        whole, (first, lines, _), (second, more, _) = lexer.block_map(a + b), lexer.block_map(a), lexer.block_map(b)
        assert whole[0] == [second[s] for s in first] and whole[1] == [n + more[s] for n, s in zip(lines, first, strict=True)]
