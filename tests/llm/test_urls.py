import re

from groundwork.llm import urls
from tests.oracle import connect, differences

S = "page_id long, url string, host string, path string, n int, child string"
L = "id long, good int"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fit = [(len(h + p), h + p, w) for w, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def test_rules_on_table(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = urls.query(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path = parse(pages[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert len({r.rule for r in got}) > 3


def test_edges(spark):
    odd = [None, "", "example.com/en/", "HTTP://ÀB.Example.COM", "://x", "a://b://c/d?e#f", "http://h?q/x", "http://h#f", "http://com/en/7", "http://example.com/en/71/", "x\n://y\nz/p\nq", "http://a.org/es/", "http://notorg/es/"]
    rows = [(k, u, "", "", 0, "") for k, u in enumerate(odd)] + [(None, "http://a.net/de/8", None, None, None, None), (0, None, "", "", 0, "")]
    labels = spark.createDataFrame([], L)
    got = urls.filter_urls(spark.createDataFrame(rows, S), labels).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path = parse(odd[r.id] if r.id is not None else "http://a.net/de/8")
        assert (r.host, r.path, r.rule) == (host, path, rule_of(host, path)[0])
        assert r.verdict == (rule_of(host, path)[1] or "allow")
    assert urls.filter_urls(spark.createDataFrame([], S), labels).count() == 0


def brute_tree(rows, good):
    """Templates and purity by the definition, over (id, host, segments)."""
    tpl = [""] * len(rows)
    for depth in range(max(len(s) for _, _, s in rows)):
        nodes = {}
        for k, (i, host, segs) in enumerate(rows):
            if len(segs) > depth:
                nodes.setdefault((host, tpl[k]), {}).setdefault(segs[depth], []).append(k)
        for (_, t), kids in nodes.items():
            everyone = [k for v in kids.values() for k in v]
            known = lambda ks: [good[rows[k][0]] for k in ks if rows[k][0] in good]
            all_ = known(everyone)
            for child, ks in kids.items():
                own = known(ks)
                keep = len(ks) >= urls.SUPPORT and own and len(all_) > len(own)
                if keep:
                    p, n, m = sum(all_) / len(all_), len(own), len(all_) - len(own)
                    err = (p * (1 - p) * (1 / n + 1 / m)) ** 0.5
                    keep = err > 0 and abs(sum(own) / n - (sum(all_) - sum(own)) / m) / err > urls.Z
                for k in ks:
                    tpl[k] = t + "/" + (child if keep else "*")
    labelled = [good[r[0]] for r in rows if r[0] in good]
    base = sum(labelled) / len(labelled)

    def smooth(ks, prior):
        own = [good[rows[k][0]] for k in ks if rows[k][0] in good]
        return (sum(own) + urls.SMOOTH * prior) / (len(own) + urls.SMOOTH)

    out = {}
    for k, (i, host, _) in enumerate(rows):
        p = smooth([j for j, r in enumerate(rows) if r[1] == host], base)
        out[i] = (tpl[k], smooth([j for j, r in enumerate(rows) if r[1] == host and tpl[j] == tpl[k]], p))
    return out


def test_tree_matches_brute_force(spark):
    paths = ["/news/{}", "/ads/{}/click", "/ads/offer-{}", "/u/deadbeefdeadbeef{}/x", "/a/b/c/d/e/f/g/{}", "/a/b/c/d/e/f/g/h/ads/{}/x/y", "/a/b/c/d/e/f/g/h/fine/{}", "/{}.html"]
    rows, good = [], {}
    for k in range(900):
        path = paths[k % 8].format(k)
        rows.append((k, f"http://h{k % 2}.example/{path[1:]}"))
        if k % 5:
            good[k] = int("/ads" not in path or k % 11 == 0)
    df = spark.createDataFrame([(*r, "", "", 0, "") for r in rows], S)
    got = urls.filter_urls(df, spark.createDataFrame(list(good.items()), L), rules=()).collect()
    shapes = {r.page_id: (r.h, r.s) for r in df.select("page_id", urls.host_of(urls.F.col("url")).alias("h"), urls.shape_of(urls.path_of(urls.F.col("url"))).alias("s")).collect()}
    want = brute_tree([(i, h, s) for i, (h, s) in shapes.items()], good)
    for r in got:
        assert r.template == want[r.id][0] and abs(r.purity - want[r.id][1]) < 1e-9
        assert r.rule is None and r.verdict == ("block" if r.purity < urls.PURITY else "allow")
    blocked = {r.id for r in got if r.verdict == "block"}
    assert blocked and all("/ads/" in rows[i][1] for i in blocked)


def test_oracle_sql(spark):
    """The SQL gives the same rows."""
    sf = "/root/testdata/sf0.01"
    assert not differences(urls.query(spark, sf), connect(sf), urls.oracle())
