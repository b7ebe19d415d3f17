"""Main text of pages, repair of conversations and periodic runs: odd rows and plain versions."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from dugout.llm import conversation_repair, html_markup, html_text, periodic_runs, queries

from .conftest import clashing, prose

EMPTY = hashlib.sha256(b"").hexdigest()


# ---- periodic runs


def plain_runs(words):
    """All runs by comparing the words with themselves, moved by every period."""
    _, ids = np.unique(np.array(words or [0]), return_inverse=True)
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], ids[q:] == ids[:-q], [False])).astype(np.int8)
        border = np.flatnonzero(np.diff(same))
        for s, e in zip(border[::2], border[1::2]):
            if e - s + q >= max(6, 4 * q):
                out.setdefault((int(s), int(e - s + q)), q)  # the smallest period of a stretch comes first
    return sorted(((s, m, q) for (s, m), q in out.items()), key=lambda r: (r[0], r[2]))


def plain_analysis(doc_id, text, damage):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if damage and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[0] if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def random_words(rng):
    words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 50))]
    for _ in range(rng.randint(0, 3)):
        period = [rng.randrange(5) for _ in range(rng.randint(1, 9))]
        at = rng.randint(0, len(words))
        words[at:at] = (period * rng.randint(2, 7))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_plain_comparison(seed):
    rng, found = random.Random(seed), 0
    for _ in range(800):
        words = random_words(rng)
        runs = plain_runs(words)
        found += len(runs)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == runs
    assert found > 500


def test_automaton_segments_are_the_last_occurrences():
    rng = random.Random(5)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(40)]
        automaton = periodic_runs.Automaton()
        for i, word in enumerate(words):
            got = {}
            for e, length in automaton.append(word):
                assert length > got.get(e, 0)
                got[e] = length
            want = {}
            for length in range(1, i + 1):  # the last end before i of each suffix
                part = words[i + 1 - length : i + 1]
                ends = [e for e in range(length - 1, i) if words[e + 1 - length : e + 1] == part]
                if ends:
                    want[ends[-1]] = length
            assert got == want


def test_long_periods_and_single_words():
    rng = random.Random(2)
    base = [rng.randrange(10_000) for _ in range(3000)]
    assert periodic_runs.runs_of(np.array(base * 4 + base[:7])) == [(0, 12007, 3000)]
    assert periodic_runs.runs_of(np.array(base * 3 + base[:2999])) == []
    assert periodic_runs.runs_of(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]
    assert periodic_runs.runs_of(np.zeros(5, np.int64)) == []
    assert periodic_runs.runs_of(np.array([0, 1] * 4)) == [(0, 8, 2)]


def test_runs_of_odd_rows(spark, docs, rows, none):
    more = [(20, "x " * 9, "en", "s", 1), (21, "a b\x1cc " * 5 + "é", "en", "s", 1), (30, "ha ha ha ha ha", None, None, 0),
            (31, "l\n" * 400 + "o l " * 300, "en", None, 0)]
    table = docs.union(spark.createDataFrame(more, docs.schema))
    for damage in (False, True):
        got = Counter(tuple(r)[:8] for r in periodic_runs.analysis(clashing(table), damage).collect())
        assert got == Counter(plain_analysis(r[0], r[1], damage) for r in [*rows, *more])
    assert periodic_runs.analysis(none).count() == 0


def test_runs_query(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    got = [tuple(r)[:8] for r in queries.QUERIES["op13_periodic_runs"](spark, sf).collect()]
    assert sorted(got) == sorted(plain_analysis(d, t, True) for d, t in docs)
    assert sum(r[1] for r in got) > 5


# ---- conversations


NEXT = {"0": "U", "S": "U", "U": "A", "A": "U"}
AFTER = {("0", "s"): "S", ("0", "u"): "U", ("S", "u"): "U", ("U", "a"): "A", ("A", "u"): "U"}


def plain_repair(rows):
    """Costs to go for every row and state, from the end; then the least letters, from the start."""
    seen, faults, count = set(), [], Counter()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
        count[fault] += 1
    n = len(rows)
    go = [dict.fromkeys("0SUA", 10**9) for _ in range(n + 1)]

    def edges(i, x):
        out = [("I", 2, i, NEXT[x])]
        if i < n:
            out.append(("D", 3, i + 1, x))
            if faults[i] not in ("blank", "duplicate"):
                cut = faults[i] == "truncated"
                out.append(("R", 2 + cut, i + 1, NEXT[x]))
                if (x, rows[i][0][:1]) in AFTER:
                    out.append(("K", cut, i + 1, AFTER[x, rows[i][0][:1]]))
        return out

    for i in range(n, -1, -1):
        if i == n:
            go[n]["0"] = go[n]["A"] = 0
        for _ in range(5):
            for x in "0SUA":
                go[i][x] = min(go[i][x], *(c + go[j][y] for _, c, j, y in edges(i, x)))
    i, x, audit, lines = 0, "0", "", []
    while i < n or go[i][x]:
        letter, _, j, y = next(e for e in sorted(edges(i, x)) if e[1] + go[e[2]][e[3]] == go[i][x])
        audit += letter
        if letter != "D":
            role = rows[i][0] if letter == "K" else {"U": "user", "A": "assistant"}[y]
            lines.append(f"{role}:{'' if letter == 'I' else rows[i][1]}")
        i, x = j, y
    illegal = sum(p[0][:1] + q[0][:1] not in ("su", "ua", "au") for p, q in zip(rows, rows[1:]))
    return (count["blank"], count["duplicate"], count["truncated"], illegal, go[0]["0"], audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_conversations(rows):
    by, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        spelled = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(spelled).encode()) % 20
        by[conv]  # noqa: B018 - every conversation is listed
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, left in by.items():
        left.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in left if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *plain_repair([r[1:] for r in left]))
    return out


ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", "agent", None, "s"]
TEXTS = ["a.", "b!", "c", "", " \t", "d", "e?", "f. ", "g\n", None, "é", "h.\x1c"]


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    rows = [(conv, rng.choice([turn, turn, None, turn + 5]), rng.choice(ROLES), rng.choice(TEXTS))
            for conv in [*range(120), None] for turn in range(rng.randint(1, 12))]
    rows += [(500, t, "user" if t % 2 else "assistant", f"line {t % 50}.") for t in range(300)]
    rows += [(501, 3, "user", "same text")] * 60 + [(501, None, "assistant", "no turn.")] * 40
    rows += [(502, t, "user", "one text!") for t in range(80)]
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone."), (600, 0, "assistant", prose(30_000, 4))]
    rng.shuffle(rows)
    return rows


def result(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("most", [4, 30, conversation_repair.PIECE])
def test_repair_of_odd_rows_whole_and_in_pieces(spark, talk, most):
    table = clashing(spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string"))
    got = result(conversation_repair.repaired(conversation_repair.damaged(table), most))
    assert got == plain_conversations(talk)
    assert conversation_repair.repaired(conversation_repair.damaged(table.limit(0)), most).count() == 0


def test_repair_query(spark, sf):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    assert result(queries.QUERIES["op12_audit_repair"](spark, sf)) == plain_conversations(rows)


def whole(rows):
    piece = conversation_repair.Piece()
    for role, text in rows:
        piece.add(None, role, text, 1, None)
    cost, audit, lines = piece.written(conversation_repair.NOTHING, None)
    c = piece.count
    return c["blank"], c["duplicate"], c["truncated"], c["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


@pytest.mark.parametrize("modulus", [conversation_repair.MODULUS, 2, 7])
def test_ties_go_to_the_least_audit_even_if_hashes_collide(monkeypatch, modulus):
    monkeypatch.setattr(conversation_repair, "MODULUS", modulus)
    rng = random.Random(modulus)
    for _ in range(1500):
        rows = [(rng.choice(ROLES) or "", rng.choice(TEXTS) or "") for _ in range(rng.randint(0, 14))]
        assert whole(rows) == plain_repair(rows)


def test_audits_compare_as_their_strings():
    rng, audits = random.Random(3), conversation_repair.Audits()
    nodes = [0]
    for _ in range(400):
        nodes.append(audits.append(rng.choice(nodes[-30:]), rng.choice("DIKR")))
    for _ in range(3000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


# ---- pages


def texts(page):
    found = html_markup.blocks(page)
    return [t for (_, _, t), keep in zip(found, html_markup.chosen(found)) if keep]


@pytest.mark.parametrize("page, want", [
    ("", []), ("plain &lt;text&gt;", ["plain <text>"]), ("<p>a<br>b &amp;amp; c&nbsp;d<p>e", ["a b &amp; c d", "e"]),
    ("<title>t</title><script>if (a<b) '</p>'</script><style>p{}</style><p>x<!-- <p>no --></p>", ["x"]),
    ("<p title='a>b'>x <b>bo</b>ld</p>tail", ["x bold", "tail"]), ("2 < 3 and <3", ["2 < 3 and <3"]),
    ("<article><header><h1>T</h1></header><p>A<footer>tags</footer></article><p>outside", ["T", "A"]),
    ("<div class='sidebar'>s</div><article>a<div id=comments><article class=comment>c</article></div></article>", ["a"]),
    ("<article><p>a <span class='share'>no</span>b</p><form>q<p>f</form><aside>r</aside>c</article>", ["a b", "c"]),
    ("<main><h1>H</h1><article>x</article>y</main>", ["H", "x"]), ("<nav>m<article>a</article>", ["a"]),
    ("<form><main><p>x</main></form>", ["x"]), ("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>", ["a", "b", "c", "d"]),
    ("<body class='has-sidebar'><div class='post with-sidebar'>p<div class='cookie-notice'>n</div></div>", ["p"]),
    ("<table><tr><td class=ad>s<td>t</table>", ["t"]), ("<div hidden>h</div><div style='display: none'>n</div>v", ["v"]),
    ("<article>unclosed <b>tail", ["unclosed tail"]), ("<p>cut <a href='x", ["cut"]), ("<nav>only</nav>", []),
    ("<textarea><p>no</textarea>y</p>z", ["y", "z"]), ("<P>A</P><ARTICLE>B</ARTICLE>", ["B"]),
    ("<div role='navigation'>n</div><div itemprop=articleBody>b</div>", ["b"]),
])
def test_markup(page, want):
    assert texts(page) == want


def plain_covered(streams):
    """Tokens in runs that enough streams hold, by a dictionary of all windows."""
    size, holders = html_text.RUN, defaultdict(set)
    for k, s in enumerate(streams):
        for i in range(len(s) - size + 1):
            holders[tuple(s[i : i + size])].add(k)
    least = max(html_text.LEAST_PAGES, -(-len(streams) * html_text.SHARE // 1))
    return {w for w, pages in holders.items() if len(pages) >= least}


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_the_suffix_array_are_those_of_all_windows(seed):
    rng = random.Random(seed)
    common = [rng.randrange(50) for _ in range(40)]
    pages = []
    for _ in range(rng.randint(3, 14)):
        own = [rng.randrange(6) for _ in range(rng.randint(0, 30))]
        a = rng.randrange(30)
        pages.append(np.array(own + common[a if rng.random() < 0.3 else 0 :] + own[:5], np.uint32))
    windows = np.array(sorted(plain_covered([p.tolist() for p in pages])), np.uint32).reshape(-1, html_text.RUN)
    want = sorted(int(html_text.run_hashes(w)[0]) for w in windows)
    assert html_text.repeated_runs(pages).tolist() == want
    assert html_text.repeated_runs([]).tolist() == []


MENU = "Start Products Prices Support Company Careers Press Contact Imprint".split()


@pytest.fixture(scope="module")
def site():
    """Pages of a host without telling markup, copies among them, and others."""
    rows = []
    for k in range(12):
        body = f"<div>{prose(40, k)}</div><div>{prose(25, k + 100)}</div>"
        menu = "".join(f"<div><a href='/{m}'>{m}</a></div>" for m in MENU)
        rows.append((k, f"http://Plain.example.org:80/{k}", f"<body>{menu}{body}<div>All rights reserved by the plain example company in Rome.</div>"))
    rows += [(20 + k, f"https://plain.example.org/copy{k}", rows[3][2]) for k in range(30)]
    rows += [(60, "https://other.example.org/", rows[0][2]), (61, None, rows[1][2]), (62, "https://plain.example.org/x", None),
             (None, "https://plain.example.org/y", ""), (63, "no address", "<p>a &copy; b"), (63, "no address", "<p>a &copy; b"),
             (64, "http://big.example.org", "<article>" + f"<p>{prose(60_000, 9)}</p>" * 2)]
    return rows


@pytest.mark.parametrize("part", [html_text.PART, 16_000])
def test_repeated_runs_of_a_host_go_and_copies_stay(spark, site, monkeypatch, part):
    monkeypatch.setattr(html_text, "PART", part)
    monkeypatch.setattr(html_text, "LEAST_PAGES", 3)
    table = spark.createDataFrame(site, "page_id bigint, url string, html string")
    got = Counter((r.page_id, r.url, r.text) for r in html_text.extracted(clashing(table)).collect())
    menu, end = "\n\n".join(MENU) + "\n\n", "\n\nAll rights reserved by the plain example company in Rome."
    body = lambda k: f"{prose(40, k)}\n\n{prose(25, k + 100)}"
    want = Counter((p, u, body(p)) for p, u, _ in site[:12])
    want.update((p, u, body(3)) for p, u, _ in site[12:42])
    want.update([(60, site[42][1], menu + body(0) + end), (61, None, menu + body(1) + end), (62, site[44][1], ""), (None, site[45][1], ""),
                 (63, "no address", "a © b"), (63, "no address", "a © b"), (64, site[48][1], "\n\n".join([prose(60_000, 9)] * 2))])
    assert got == want
    assert html_text.extracted(table.limit(0)).count() == 0


def test_pages_query(spark, sf):
    """The pages given here have their text in h1 and p elements of one article."""
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    want = {}
    for page_id, url, page in pages:
        article = re.search("<article>(.*)</article>", page, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?h1>|</?p>", article)]
        text = "\n\n".join(p for p in parts if p)
        want[page_id] = (url, text, len(text))
    got = queries.QUERIES["op11_host_suffixes"](spark, sf).collect()
    assert {r.page_id: (r.url, r.text, r.n_chars) for r in got} == want and len(got) == len(pages)


def test_new_queries_have_defined_columns(spark, sf):
    wanted = {"op11_host_suffixes": "page_id url text n_chars", "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
              "op12_audit_repair": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256"}
    for name, columns in wanted.items():
        assert queries.QUERIES[name](spark, sf).columns[: len(columns.split())] == columns.split()
    assert EMPTY in {r.collapsed_sha256 for r in periodic_runs.analysis(spark.createDataFrame([(1, None)], "doc_id int, text string")).select(F.col("collapsed_sha256")).collect()}
