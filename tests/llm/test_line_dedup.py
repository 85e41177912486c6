import random
import re
import time

import duckdb

from helixframe.llm.line_dedup import RATIO, SQL, drop_boilerplate


def lines(html):
    t = re.sub(r"(?is)<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)|<!--.*?(?:-->|\Z)|</?(?:p|div|br)\b[^<>]*>", "\n", html or "")
    t = re.sub(r"<[^<>]*>", "", t)
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&amp;", "&")):
        t = t.replace(a, b)
    return [s for x in t.replace("\r", "\n").replace("\t", " ").split("\n") if (s := x.strip(" "))]


def host(url):
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", url or "")
    return m[1].lower() if m else ""


def brute(pages):
    total, seen = {}, {}
    for _, u, h in pages:
        total[host(u)] = total.get(host(u), 0) + 1
        for x in set(lines(h)):
            seen[host(u), x] = seen.get((host(u), x), 0) + 1
    out = []
    for p, u, h in pages:
        k = host(u)
        out.append((p, k, [x for x in lines(h) if not (k and seen[k, x] > 1 and seen[k, x] > RATIO * total[k])]))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    pages = []
    for i in range(300):
        h = rng.choice(["Hot.example", "hot.example", "b.example:80", "u:p@c.example", "d.example"])
        body = ["<p>menu</p>", f"<div class='x'>only {i}</div>", f"<p>some {i % 4} &amp; x</p>", "<script>var a = '<p>menu</p>'</script>", "<br>menu\r\n\tmenu", "<b>part</b>ly<p>"]
        pages.append((i, f"http://{h}/{i}?q", "".join(rng.sample(body, rng.randrange(1, 6)))))
    pages += [(900, None, "<p>menu</p>"), (901, "no url", "x"), (902, "http://hot.example/", None), (903, "http://hot.example/", ""), (1, "http://hot.example/1", "menu"), (None, "http://hot.example/z", "menu\nmine")]
    pages += [(904, "http://hot.example/long", "<p>menu</p>" + "w " * 100000)]
    pages += [(905 + i, f"http://small{i % 7}.example/{i}", f"<p>same<p>own {i}<i>") for i in range(16)] + [(950, "http://solo.example/", "<p>menu<br>alone<")]
    pages += [(960 + i, f"http://open.example/{i}", h) for i, h in enumerate(["a<script>b<p>c", "a<br>b<!-- c<p>d", "a<style x>b", "a < b <p>c > d<p", "<p<p>x<b<i>y</i>", "a</script >b<SCRIPT>c</SCRIPT\t>d"])]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string").repartition(3)
    got = drop_boilerplate(df).collect()
    assert sorted(((r.page_id, r.host, r.kept) for r in got), key=str) == brute(pages)
    assert drop_boilerplate(df.limit(0)).count() == 0


def test_pages_without_end_are_read_once(spark):
    """Two million characters of what never closes."""
    pages = [(i, f"http://h{i % 2}.example/", part * (2_000_000 // len(part))) for i, part in enumerate(["<", "<!--", "<script>", "<style ", "<p ", "</script", "< ", "-->", "<p>", "&amp;"])]
    began = time.time()
    assert len(drop_boilerplate(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)).select("page_id").collect()) == len(pages)
    assert time.time() - began < 60


def test_sql_reads_open_tags_alike(spark, tmp_path):
    from helixframe.llm.line_dedup import op4_line_dedup

    rows = [(i, f"http://h{i % 2}.example/{i}", h) for i, h in enumerate(["a<script>b<p>c", "a<br>b<!-- c<p>d", "a<style x>b", "a < b <p>c > d<p", "<p<p>x<b<i>y</i>", "a</script >b<SCRIPT>c</SCRIPT\t>d", None, ""])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages(page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    cols = "page_id, host, n_lines, n_dropped, kept_sha256"
    assert sorted(con.execute(f"SELECT {cols} FROM ({SQL})").fetchall()) == sorted(map(tuple, op4_line_dedup(spark, str(tmp_path)).selectExpr(*cols.split(", ")).collect()))
