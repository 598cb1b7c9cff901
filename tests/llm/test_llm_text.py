"""Language, personal data, pages, quality and contamination on awkward rows."""

import html as entities
import random
import re

import llm_data as data
import pytest
from pyspark.sql import functions as F

from parity.llm import decontaminate, language, private, quality, template

SF = "/root/testdata/sf0.001"


# ---- language


def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    extra = [(None, "the and", "en"), (900001, None, "en"), (900002, "", None), (900003, "12 34 !!", "fr"),
             (900004, "the of and", None)]
    return docs.union(spark.createDataFrame(extra, docs.schema)).selectExpr("*", "'z' AS said", "'z' AS id", "1 AS n")


def test_language_on_held_out_documents(spark):
    docs = labelled(spark)
    got = language.identify(docs, per_language=200)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    both = got.join(docs.select("doc_id", "lang"), "doc_id").where("lang IS NOT NULL AND held_out").collect()
    right = sum(r.lang == r.lang_pred for r in both if r.doc_id < 900000)
    assert right >= 0.9 * len([r for r in both if r.doc_id < 900000]) and len(both) > 40
    odd = {r.doc_id: r for r in got.where("doc_id > 900000 OR doc_id IS NULL").collect()}
    assert odd[None].lang_pred in {"en", "de", "fr", "es"} and odd[None].held_out is False
    assert [odd[k].lang_pred for k in (900001, 900002, 900003)] == ["und"] * 3
    assert all(odd[k].score == 0 for k in (900001, 900002, 900003)) and 0 < odd[900004].score <= 1
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {900001, 900002, 900003}


def test_other_languages_and_noise_are_not_accepted(spark):
    rng = random.Random(7)
    planted = {
        900010: "Москва является столицей России и крупнейшим городом страны по численности населения",
        900011: "北京是中华人民共和国的首都也是全国政治文化中心",
        900012: " ".join("".join(rng.choice("qwertyuiopasdfghjklzxcvbnm") for _ in range(rng.randrange(3, 9))) for _ in range(60)),
        900013: "Warszawa jest stolicą Polski i największym miastem w kraju położonym nad rzeką Wisłą " * 4,
        900014: "asdf jkl; qwer zxcv asdfgh lkjhg " * 5,
    }
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.union(spark.createDataFrame([(k, t, None) for k, t in planted.items()], docs.schema))
    kept = sorted(r.doc_id for r in language.accepted(both).collect())
    assert kept == sorted(r.doc_id for r in docs.collect())


def test_language_learns_from_the_other_folds_only(spark):
    docs = labelled(spark)
    swapped = docs.withColumn("lang", F.when(language.fold(F.col("doc_id")) == 1, F.lit("xx")).otherwise(F.col("lang")))
    assert language.train(swapped).languages == language.train(docs).languages == ("de", "en", "es", "fr")


def test_language_of_empty_tables(spark):
    none = labelled(spark).limit(0)
    assert language.identify(none).count() == 0
    unlabelled = spark.createDataFrame([(1, "the text", None)], "doc_id bigint, text string, lang string")
    assert [tuple(r) for r in language.identify(unlabelled).collect()] == [(1, False, "und", 0.0)]


def test_language_slices_add_up(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc é\n") for _ in range(n)) for n in (1, 2, 3, 64, 65, 66, 500)]
    whole = language.gram_counts(texts, 1 << 10)
    monkeypatch.setattr(language, "SLICE", 64)
    assert (language.gram_counts(texts, 1 << 10) == whole).all()


# ---- personal data


def by_patterns(text):
    out = []
    for kind, pattern, test in ((0, private.EMAIL, bool), (1, private.IP, private.is_ip), (2, private.CARD, private.is_card),
                                (3, private.PHONE, private.is_phone)):
        out += [(kind, *m.span()) for m in pattern.finditer(text) if test(m[0])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_base_spans_are_those_of_the_patterns(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice("124 +().-@ab.9%é\n") for _ in range(rng.randrange(60)))
        assert private.base_spans(text)[0] == by_patterns(text), text
    digits = "4539578763621486"
    assert private.base_spans(f"x {digits} y")[0] == [(2, 2, 18)]


def test_model_parts_what_the_patterns_run_together(spark):
    rng = random.Random(5)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + str(k) for k in range(10) if private.luhn(d + str(k)))

    rows = []
    for i in range(150):
        middle = rng.choice([card(), f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", f"10.2.{i % 250}.7",
                             f"w.{i}@mail.example.com", str(rng.randrange(10**15, 10**16)), f"{i}.5"])
        rows.append((i, f"{data.prose(rng, 5)} {middle} {data.prose(rng, 5)}"))
    a, b = card(), card()
    rows += [(1000, f"two {a} {b} cards"), (1001, "call +1 (222) 555-1234 10.20.30.40 now"), (1002, None), (1003, ""),
             (1000, f"two {a} {b} cards"), (None, "me@example.org"), (1004, "9 " * 3000)]
    got = private.detect(data.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    spans = {r.doc_id: r for r in got}
    assert spans[1000].base == "" and spans[1000].spans == f"card:4:{4 + 16},card:21:{21 + 16}"
    assert spans[1001].spans == "ip:23:34,phone:5:22" and spans[1001].n_phone == 0 and spans[1001].n_ip == 1
    assert (spans[1002].spans, spans[1003].spans, spans[1004].spans, spans[None].spans) == ("", "", "", "email:0:14")
    for r in got:
        assert set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
    assert private.detect(data.frame(spark, [])).count() == 0
    shown = spark.createDataFrame([("ab cd ef", "ip:3:5")], "t string, s string")
    assert shown.select(private.masked(F.col("t"), F.col("s"))).first()[0] == "ab [ip] ef"


# ---- pages


def page(body, title="t"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_pages_of_one_template(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(12):
        text = [data.prose(rng, 30) for _ in range(3)]
        body = (
            f"<div class='top-menu'><ul><li><a href=/>home</a><li>about</ul></div><div id=content><h1>{text[0]} &amp; x</h1>"
            f"<p>{text[1]}\n  <b>bold</b><br>more<p>{text[2]}<aside>see also {i}</aside><div class='comments'><p>nice!</div>"
            f"<form><input>send</form><script>var a='</p>'</script></div><p class=foot>all rights reserved</p><footer>f{i}</footer>"
        )
        rows.append((i, f"http://a.example.com/{i}", page(body)))
        want[i] = f"{text[0]} & x\n{text[1]} bold more\n{text[2]}"
    rows += [(50, "http://b.example.com/", None), (51, None, ""), (52, "x", "no markup &lt;b&gt; at  all"),
             (53, "http://c.example.com/1", "<article><p>cut off <b>here"), (50, "http://b.example.com/", None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' AS host", "1 AS id", "2 AS page")
    got = {r.page_id: r.text for r in template.extract(df).collect()}
    assert {i: got[i] for i in want} == want
    assert (got[50], got[51], got[52], got[53]) == ("", "", "no markup <b> at all", "cut off here")
    assert template.extract(df).count() == len(rows)
    assert template.extract(df.limit(0)).count() == 0


def test_given_pages_keep_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in template.extract(pages).collect()}
    for r in pages.collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        blocks = (re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b)) for b in re.split("</?(?:p|h1)>", inner))
        lines = (re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in blocks)
        assert got[r.page_id] == "\n".join(x for x in lines if x)


def texts_of(spark, pages):
    rows = [(i, url, page(body)) for i, (url, body) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return [r.text for r in template.extract(df).orderBy("page_id").collect()]


def test_every_slot_with_data_is_read(spark):
    """A lead beside the content, on some pages most of the text."""
    rng = random.Random(11)
    pages, want = [], []
    for i in range(10):
        lead, content = data.prose(rng, 80 if i == 3 else 8), data.prose(rng, 5 if i == 3 else 60)
        pages.append((f"http://a.example.org/{i}", f"<article><div class=lead>{lead}</div><div class=content>{content}</div></article>"))
        want.append(f"{lead}\n{content}")
    assert texts_of(spark, pages) == want


def test_hints_do_not_hide_the_article(spark):
    rng = random.Random(12)
    pages, want = [], []
    wrappers = ("layout has-sidebar", "page no-sidebar", "content-with-sidebar", "post has-comments", "widget-content", "sidebar")
    for k, label in enumerate(wrappers):
        for tag in ("article", "div"):
            text = data.prose(rng, 40)
            pages.append((f"http://h{k}{tag}.example.org/", f"<div class='{label}'><{tag}>{text}</{tag}></div><div class='sidebar-links'>links</div>"))
            want.append(text)
    text = data.prose(rng, 40)
    pages.append(("http://f.example.org/", f"<form><div>{text}<div class='site-footer'>imprint</div></div></form>"))
    pages.append(("http://g.example.org/", f"<article>{text[:20]}</article><div class=comments>{text}<article>more</article></div>"))
    # one page of the host is too short for its wrapper to hold most of its text
    for i in range(4):
        text_i = data.prose(rng, 2 if i == 3 else 50)
        pages.append((f"http://i.example.org/{i}", f"<div class=widget>{text_i}</div><p>{data.prose(rng, 6)}</p>"))
    got = texts_of(spark, pages)
    assert got[:-4] == [*want, text, text[:20].strip()]
    assert all(len(t.split("\n")) == 2 for t in got[-4:])


def test_deviating_pages_leave_the_template(spark):
    """An error page, plain text and a second page type on one host; short articles between long notices."""
    rng = random.Random(13)
    notice = data.prose(rng, 40)
    pages, want = [], []
    for i in range(20):
        a, b = data.prose(rng, 4), data.prose(rng, 4)
        pages.append((f"http://a.example.org/{i}", f"<div class=top><p>{notice}</div><div class=text><p>{a}<p>{b}</div><div class=low>all rights</div>"))
        want.append(f"{a}\n{b}")
    for i in range(10):
        a = data.prose(rng, 6)
        pages.append((f"http://a.example.org/p{i}", f"<div class=head>the shop</div><div class=item>{a}</div><div class=order>order now</div>"))
        want.append(a)
    pages.append(("http://a.example.org/e", "<h1>not found</h1>"))
    copies = [("http://a.example.org/c", f"<div class=text>{notice[:30]} same</div>")] * 3
    assert texts_of(spark, pages + copies) == [*want, "not found", *[f"{notice[:30]} same"] * 3]


# ---- quality


def measured(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_measures(spark):
    rows = [(i, t and t[:1500]) for i, t in data.awkward()]
    rows += [(20, "a b c a b c\na b c a b c\n\n  \nx　y\x1cz # $"), (21, "line\nline\nline\r\nline"), (22, "a a a a")]
    got = quality.ledger(data.frame(spark, rows)).collect()
    got = data.counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert got == data.counted((i, *measured(t)) for i, t in rows)
    assert quality.ledger(data.frame(spark, [])).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.ledger(docs)
    applied = quality.apply_policies(rows).collect()
    bit = {r.name: 1 << i for i, r in enumerate(quality.RULES)}
    table = {(r.policy, r.rule): r for r in quality.ablations(rows).collect()}
    for policy, names in quality.POLICIES.items():
        mask = sum(bit[n] for n in names)
        assert all(getattr(r, f"kept_{policy}") == (r.failed_bits & mask == 0) for r in applied)
        for n in names:
            r = table[policy, n]
            assert r.n_failed == sum(a.failed_bits & bit[n] > 0 for a in applied)
            assert r.n_failed_alone == sum(a.failed_bits & mask == bit[n] for a in applied)
            assert r.n_kept_without == sum(a.failed_bits & mask & ~bit[n] == 0 for a in applied)
    assert all(r.n_failed == 0 for r in quality.ablations(rows.limit(0)).collect())


# ---- contamination


def contaminated(rows, items, window=10):
    def cut(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    grams = {}
    for i, t in items:
        w = cut(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for i, t in rows:
        w = cut(t)
        hit, names = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    names |= grams[g]
        out.append((i, len(w), len(hit), len(names), ",".join(sorted(names)), bool(hit)))
    return data.counted(out)


@pytest.mark.parametrize("options", [{}, {"broadcast_rows": 0}, {"shingle": 3}, {"window": 4, "shingle": 9}, {"window": 20, "shingle": 5}])
def test_contamination(spark, options):
    rng = random.Random(3)
    stock = [f"w{i}" for i in range(12)]
    items = [(i, data.prose(rng, rng.choice([0, 1, 3, 7, 10, 14, 30]), stock)) for i in range(25)]
    items += [(30, None), (31, ""), (32, " . "), (33, "É Straße ABC"), (7, "rare unusual passage")]
    rows = data.awkward()[:-8]
    rows += [(100 + i, f"{data.prose(rng, rng.randrange(40), stock)}. {rng.choice(items)[1] or ''}, x") for i in range(60)]
    rows += [(200, "a É straße abc b"), (201, "é STRASSE abc"), (200, "a É straße abc b")]
    long_item = data.prose(rng, 20, [f"u{i}" for i in range(400)])
    items.append((40, long_item))
    rows += [(300, long_item), (301, " ".join("other" if k in (9, 10) else w for k, w in enumerate(long_item.split())))]
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS words", "2 AS gram")
    docs = data.frame(spark, rows).repartition(3)
    got = decontaminate.report(docs, bench, **options).collect()
    got = data.counted((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got)
    expected = contaminated(rows, items, options.get("window", 10))
    assert got == expected
    kept = decontaminate.clean(docs, bench, **options)
    assert kept.columns == docs.columns
    clean = [r for r in expected.elements() if not r[5]]
    assert data.counted((r.doc_id,) for r in kept.collect()) == data.counted((r[0],) for r in clean)


def test_contamination_of_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    docs = data.frame(spark, data.awkward())
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
