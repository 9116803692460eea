import random

from docloom.llm import html_diff as hd


def _page(lines):
    return "<!DOCTYPE html><html><head><title>t</title><style>x</style></head><body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body></html>"


def _pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, text string, lines string")


def lcs(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            n[i + 1][j + 1] = n[i][j] + 1 if a[i] == b[j] else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_lines_are_a_longest_common_subsequence():
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 14))] for _ in range(2))
        shared = hd.common_lines(a, b)
        kept = [x for x, s in zip(a, shared) if s]
        assert len(kept) == lcs(a, b)
        at = iter(b)
        assert all(x in at for x in kept)
    assert sum(hd.common_lines([str(i % 97) for i in range(4000)], [str(i % 89) for i in range(4000)])) > 0


def brute(rows):
    """page, neighbour and text: of the nearest pages of other lines before and after on the host, the one of the nearer path."""
    keyed = sorted((*hd.url_key(u), -(2**63) if i is None else i, "\n".join(hd.text_lines(h)), i) for i, u, h in rows)
    out = []
    for k, (host, path, _, lines, i) in enumerate(keyed):
        differs = lambda o: host and o[0] == host and o[3] not in ("", lines)  # noqa: B023, E731
        sides = [next(filter(differs, side), None) for side in (keyed[:k][::-1], keyed[k + 1 :])]
        found = [(*(-x for x in hd.nearness(path, o[1])), place, o) for place, o in enumerate(sides) if o and lines]
        own = lines.split("\n") if lines else []
        if found:
            other = min(found, key=lambda x: x[:3])[3]
            shared = hd.common_lines(own, other[3].split("\n"))
            out.append((i, other[4], "\n".join(x for x, s in zip(own, shared) if not s)))
        else:
            out.append((i, None, "\n".join(own)))
    return sorted(out, key=str)


def test_equals_brute_force_whatever_the_ranges(spark):
    rnd = random.Random(2)
    rows = []
    for i in range(300):
        host = rnd.choice(["hot.example"] * 6 + [f"h{k}.example" for k in range(20)])
        frame = [f"{host} menu {k}" for k in range(3)]
        rows.append((i, f"http://{host}/{rnd.choice('ab')}/{rnd.randrange(200)}", _page([*frame, *(f"body {i} {k}" for k in range(rnd.randint(0, 6))), f"{host} foot"])))
    expected = brute(rows)
    for size in (4000, 40, 7):
        got = sorted(((r["page_id"], r["neighbour_id"], r["text"]) for r in hd.extract_by_difference(_pages(spark, rows), size).collect()), key=str)
        assert got == expected
    assert sum("menu" not in t for *_, t in expected) > 200


def test_edges(spark):
    rows = [(1, None, _page(["a"])), (2, "no url", _page(["b"])), (3, "http://one/x", _page(["c", "d"])), (4, "http://two/1", None), (5, "http://two/2", ""), (6, "http://two/3", _page(["e"] * 20_000)), (None, "http://two/4", _page(["e", "f"])), (7, "http://tri/a", _page(["q"])), (7, "http://tri/a", _page(["q"]))]
    got = {}
    for r in hd.extract_by_difference(_pages(spark, rows)).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert got[1][0]["text"] == "a" and got[2][0]["text"] == "b" and got[3][0]["text"] == "c\nd"
    assert got[4][0]["text"] == "" and got[5][0]["n_lines"] == 0 and got[None][0]["text"] == "f"
    assert [r["text"] for r in got[7]] == ["q", "q"] and sum(map(len, got.values())) == len(rows)
    assert hd.extract_by_difference(_pages(spark, [])).count() == 0


def test_text_lines():
    html = "<p>a &amp; b<br>c</p><script>var x = '<p>no</p>';</script><!-- <p>no</p> --><div><b>d</b>e<p>f"
    assert hd.text_lines(html) == ["a & b", "c", "de", "f"] and hd.text_lines("<script>never closed") == []


def test_pages_of_equal_lines_share_their_neighbours(spark):
    frame = ["menu", "imprint"]
    page = lambda i, body: (i, f"http://host/p{i:03d}", _page([*frame, *body]))
    rows = [page(i, ["same"]) for i in range(25)] + [page(25, ["other"]), (26, "http://host/p026", None), page(27, ["third"])]
    rows += [(50 + i, f"http://twin/{i}", _page(["menu", "copy" if i < 2 else "end"])) for i in range(3)]
    for size in (4000, 7, 3):
        got = {r["page_id"]: (r["neighbour_id"], r["text"]) for r in hd.extract_by_difference(_pages(spark, rows), size).collect()}
        assert all(got[i] == (25, "same") for i in range(25)) and got[25] == (24, "other") and got[27] == (25, "third")
        assert got[26] == (None, "") and got[50] == got[51] == (52, "copy")


def test_runs_equal_brute_force_whatever_the_ranges(spark):
    rnd, rows = random.Random(4), []
    for i in range(200):
        host = rnd.choice(["hot.example"] * 4 + [f"h{k}.example" for k in range(8)])
        rows.append((i, f"http://{host}/{rnd.choice('ab')}/{rnd.randrange(40)}", rnd.choice([None, "", *[_page([f"{host} menu", f"body {k}"]) for k in (1, 1, 1, 1, 2)]])))
    expected = brute(rows)
    for size in (4000, 20, 5):
        assert sorted(((r["page_id"], r["neighbour_id"], r["text"]) for r in hd.extract_by_difference(_pages(spark, rows), size).collect()), key=str) == expected


def test_fewer_ranges_than_pages_ask_for(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.example/{i % 40}", _page([f"menu {i % 3}", f"body {i // 2}"])) for i in range(200)]
    monkeypatch.setattr(hd, "MOST_RANGES", 4)
    assert sorted(((r["page_id"], r["neighbour_id"], r["text"]) for r in hd.extract_by_difference(_pages(spark, rows), 5).collect()), key=str) == brute(rows)


def test_optional_and_missing_ends():
    assert hd.text_lines("<html><head><title>t</title><body><p>Hello world</p>") == ["Hello world"]
    assert hd.text_lines("<head><meta charset=x><title>t</title><link rel=y><p>a<p>b") == ["a", "b"]
    assert hd.text_lines("<head><title>t</title> bare text <p>b") == ["bare text", "b"]
    assert hd.text_lines("<head><title>never closed <p>a</p>") == ["never closed", "a"]
    assert hd.text_lines("<HEAD><STYLE>x</STYLE></HEAD>a<SCRIPT>b</script >c<!-- d") == ["a c"] and hd.text_lines("a < b <c") == ["a < b <c"]
    assert hd.text_lines("<headline>a</headline><header>b</header>") == ["a", "b"]


def test_hostile_pages_take_linear_time():
    import time

    began = time.time()
    for piece in ("<script ", "<script>", "<!--", "<a", "</", "<head>", "<title>", "<", "<!", "<script></script ", "<head><title>"):
        hd.text_lines(piece * (300_000 // len(piece)))
        hd.text_lines(piece * (300_000 // len(piece)) + ">")
    assert time.time() - began < 10
