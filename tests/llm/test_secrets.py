from __future__ import annotations

import collections
import hashlib
import random
import re
import time

import pytest

from helixframe.llm import queries, secrets
from helixframe.llm.common import table

KEY = "AKIA" + "B2C3D4E5F6G7H8I9"
HEXES = "0123456789abcdef" * 2

PATTERNS = [
    ("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]+"),
]


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            ok = len(m[2]) >= 6 if k == 0 else len(m[0]) >= (20 if k == 1 else 24)
            if ok:
                found.append((m.start(), k, m.end(), kind))
    joined = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
    counts = tuple(sum(x[1] == k for x in found) for k in range(3))
    return counts, hashlib.sha256(joined.encode()).hexdigest()


def test_query_matches_brute_force(spark, medium):
    texts = {r.doc_id: r.text for r in table(spark, medium, "documents").collect()}
    rows = queries.op8_secret_scans(spark, medium).collect()
    assert len(rows) == len(texts) and any(r.n_assign for r in rows)
    for r in rows:
        assert ((r.n_assign, r.n_access, r.n_hex), r.base_sha256) == brute(texts[r.doc_id])


@pytest.mark.parametrize(
    "text",
    [
        "password=abc", "PassWord = 'abcdef'", 'token: "x" secret=abcdefg', f"{KEY} {KEY[:19]}", f"a{HEXES}g{HEXES[:23]}",
        "paſſword=abcdefg toKen=abcdefg", "api_key==abcdef", "password=password=abcdefgh", "token\t=abcdefg",
        "中\U0001f600secret:abcdef1", "passwordpassword : aaaaaa", "", None, "token=ab token=abcdef",
    ],
)
def test_base_spans(text):
    row = secrets._row(text or "")
    assert (row[:3], row[3]) == brute(text)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('db_pwd = "s3cr3tPa55word"', "s3cr3tPa55word"), ("privateKey: 'Zx9vBn2LmQ8r'", "Zx9vBn2LmQ8r"),
        ('k = "Zx9vBn2LmQ8r"\nclient_credential = k', "Zx9vBn2LmQ8r"), ("<accessKey>Zx9vBn2LmQ8r</accessKey>", "Zx9vBn2LmQ8r"),
        ('"access_key" => "Zx9vBn2LmQ8r",', "Zx9vBn2LmQ8r"), ("passphrase := `Zx9vBn2LmQ8r`", "Zx9vBn2LmQ8r"),
        ('let pwd: string = "Zx9vBn2LmQ8r"', "Zx9vBn2LmQ8r"), ("export SIGNING_KEY=Zx9vBn2LmQ8r", "Zx9vBn2LmQ8r"),
    ],
)
def test_lexer_finds(text, value):
    spans = secrets.all_spans(text)[1]
    assert [text[a:b] for a, k, b in spans if k == 3] == [value]


def test_lexer_joins_pieces():
    text = 'a = "Zx9vBn2"\nsigning_key = a + "LmQ8rTy5"'
    assert [text[a:b] for a, k, b in secrets.all_spans(text)[1] if k == 3] == ["Zx9vBn2", "LmQ8rTy5"]


@pytest.mark.parametrize(
    "text",
    [
        "the key: nothing to see", 'pwd = "changeme"', 'pwd = os.environ["PWD"]', 'colour = "Zx9vBn2LmQ8r"', "pwd == other",
        'pwd = "${VAULT_PWD}"', "he said: auth matters, pass: it on", "http://example.org/a?b=c", 'pwd = ""', "pwd =",
    ],
)
def test_lexer_leaves(text):
    assert not [x for x in secrets.all_spans(text)[1] if x[1] == 3]


def test_redaction_and_edges(spark, edges, no_docs):
    assert secrets.redact(f"a {KEY} b password=hunter22 c") == "a [REDACTED] b [REDACTED] c"
    assert secrets.scan(edges).count() == edges.count()
    clean = secrets.redacted(edges)
    assert clean.columns == edges.columns
    assert sorted(map(str, clean.collect())) == sorted(map(str, edges.collect()))  # nothing to redact there
    assert secrets.scan(no_docs).count() == 0
    none = secrets.scan(edges).filter("doc_id = 1").first()
    assert none.base_sha256 == hashlib.sha256(b"").hexdigest() and none.spans == ""


LETTERS = "Zx9vBn2LmQ8rTy5w"


@pytest.mark.parametrize("form", ['client_credential = "{}"', "client_credential = '{}'", "client_credential := `{}`", "client_credential={}", "<accessKey>{}</accessKey>"])
def test_long_literals_are_read_whole(form):
    value = (LETTERS * 320)[:5000]
    text = f"a\n{form.format(value)}\nb"
    assert [text[a:b] for a, k, b in secrets.all_spans(text)[1] if k == 3] == [value]
    assert LETTERS[:6] not in secrets.redact(text)


def test_every_piece_of_a_concatenation():
    pieces = [f"{LETTERS[i % 9 : i % 9 + 7]}{i:03d}" for i in range(100)]
    at_once = "signing_key = " + " + ".join(f'"{p}"' for p in pieces)
    by_lines = 'k = ""\n' + "\n".join(f'k = k + "{p}"' for p in pieces) + "\nsigning_key = k\n"
    for text in (at_once, by_lines):
        assert [text[a:b] for a, k, b in secrets.all_spans(text)[1] if k == 3] == pieces
        assert not any(p in secrets.redact(text) for p in pieces)


def test_long_runs_and_doublings_take_linear_time():
    for text in ("auth_key=7" * 20_000, 'k = "Zx9vBn2"\n' + "k = k + k\n" * 200 + "signing_key = k", 'k = ""\n' + 'k = k + "Zx9v"\n' * 5_000 + "signing_key = k"):
        start = time.monotonic()
        assert secrets.Lexer(text).run().secrets()
        assert time.monotonic() - start < 10


def test_names_and_distances_of_any_length():
    value = "q7Zr" * 8
    long = "x" * 300 + "_password"
    for text in (f'{long} = "{value}"', f'password{" " * 300}= "{value}"', f'secret: {"Optional[" * 30}str{"]" * 30} = "{value}"',
                 f"<{long}>{value}</{long}>", f'{long} = "{value}"\ntoken = {long}\n', f'"client_secret" => "{value}"'):
        at = text.index(value)
        assert any(a <= at and at + len(value) <= b for a, _, b in secrets.all_spans(text)[1]), text[:40]


def test_lexer_against_a_plain_reader():
    """Statements on lines of their own, read by a plain splitter, against the lexer's spans."""
    rng = random.Random(4)
    names = ["db_password", "user", "apiKey", "title", "token", "count", "authToken", "x"]
    for _ in range(200):
        lines, want, known, at = [], set(), {}, 0
        for k in range(rng.randint(1, 8)):
            name, op = rng.choice(names) + rng.choice(["", str(k)]), rng.choice([" = ", ": ", " := ", " => "])
            if known and rng.random() < 0.3:
                ref = rng.choice(sorted(known))
                line, span = f"{name}{op}{ref}", known[ref]
            else:
                value = "".join(rng.choice("abcXYZ019_") for _ in range(rng.choice([3, 12, 30])))
                line = f'{name}{op}"{value}"'
                span = (at + len(line) - 1 - len(value), at + len(line) - 1)
            lines.append(line)
            known[name] = span
            text = "\n".join(lines)
            one = secrets.Value(collections.Counter(text[slice(*span)]), True, text[slice(*span)], text[slice(*span)])
            if secrets.name_weight(name) >= 0.5 and secrets.name_weight(name) * secrets.value_weight(one) >= 0.5:
                want.add(span)
            at += len(line) + 1
        assert secrets.Lexer("\n".join(lines)).run().secrets() == sorted(want), lines


def test_time_of_long_texts_is_linear():
    def took(text):
        began = time.perf_counter()
        secrets.all_spans(text)
        return time.perf_counter() - began

    for piece in ("a=b=c=d=", "name: ", "x" * 50, 'k = "v" ', "<a>", "a.b-c:d "):
        took(piece * 2000)
        assert took(piece * 40_000) < 60 * took(piece * 2000) + 0.5, piece
