"""Column rules on literal rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tenderflow.functions import contact, description, identity, naics, names, records, text, titles
from tenderflow.functions import signals as S
from tenderflow.functions.html import page_links, page_text
from tenderflow.functions.similarity import similar_percent
from tenderflow.functions.text import parse_day
from tenderflow.operators import pages


@pytest.mark.parametrize(
    "given, key",
    [
        ("https://www.Example.gov/bids/123/", "example.gov/bids/123"),
        ("https://pr-webs-customer.des.wa.gov/", "pr-webs-customer.des.wa.gov"),
        ("  HTTP://a.b/c//\t", "a.b/c"),
        (None, ""),
    ],
)
def test_url_key(one, given, key):
    assert one(identity.url_key("x"), x=given) == key


@pytest.mark.parametrize(
    "given, key",
    [("Corporate: Canal Clearing", "canal clearing"), (" CORPORATE:x  Y\n z ", "x y z"), ("", ""), ("corporate", "corporate")],
)
def test_title_key(one, given, key):
    assert one(identity.title_key("x"), x=given) == key


def test_url_variants(one):
    got = one(identity.url_variants("x"), x="https://www.Example.gov/bid/1/")
    assert got[0] == "https://www.Example.gov/bid/1/"
    assert {"example.gov/bid/1", "https://example.gov/bid/1", "http://www.example.gov/bid/1"} <= set(got)
    assert one(identity.url_variants("x"), x=" ") == []


@pytest.mark.parametrize(
    "given, key",
    [
        ("City of Miami", "miami city"),
        ("Miami, City of", "miami city"),
        ("City and County of Denver", "denver city county"),
        ("Routt County", "routt county"),
        ("County of Routt", "routt county"),
        ("<b>Café  Núñez</b>!", "café núñez"),
        ("--", ""),
    ],
)
def test_canonical_name(one, given, key):
    assert one(names.canonical_name("x"), x=given) == key


def test_hosts(one):
    assert one(names.url_host("x"), x="www.co.routt.co.us/Bids.aspx") == "co.routt.co.us"
    assert one(names.is_portal_host(names.url_host("x")), x="https://www.bidnetdirect.com/a") is True
    assert one(names.is_portal_host(names.url_host("x")), x="https://notbonfirehub.com") is False
    assert one(names.subdomain_hint("x"), x="https://city-of-rifle.bonfirehub.com/portal/") == "City Of Rifle"
    assert one(names.subdomain_hint("x"), x="https://rifle.bonfirehub.com/portal/") == ""


def test_vendor_names(one):
    assert one(names.organization_name("x"), x="BidNet Direct — City of Rifle") == "City of Rifle"
    assert one(names.organization_name("x"), x="Bonfire Hub") == ""
    assert one(names.organization_name("x"), x="n/a") == ""


def test_significant_tokens(one):
    assert one(names.significant_tokens("x"), x="Department of Water and Water Services, Ny") == ["water"]


def test_organization_hints(one):
    got = one(
        names.organization_hints("s", "i", "l", "u", "t", "d"),
        s="City of Rifle", i="city of rifle", l="https://a-town.bonfirehub.com", u="", t="x",
        d="Agency: Roads | Bridges; ab\nBuyer : Jane Doe",
    )
    assert got == ["City of Rifle", "Town", "Roads", "Bridges", "Jane Doe"]


def test_hints_from_text(one):
    assert one(names.state_hint("f", "t", "d"), f="N/A", t="XX and", d="in TX or CA") == "TX"
    assert one(names.state_hint("f", "t", "d"), f="Ohio", t="", d="TX") == "Ohio"
    assert one(names.category_hint("f", "t", "d"), f="", t="a", d="Category: Roads\nmore") == "Roads"


def test_clean_description(one):
    assert one(description.clean_description("x"), x="a: b\r\n\r\nFoo NOT provided\nnaics 541\n c ") == "a: b\n c"


def test_clean_description_of_texts_with_and_without_odd_lines(spark):
    rnd = random.Random(3)
    parts = ["", " ", "\t", "\x0b\0", "a line", " b ", "Not Provided", "say nOt provided now", "NAICS 5", " naics: 1", "no naics", "\u0130naics", "\u00a0"]
    texts = ["".join(x for _ in range(rnd.randint(0, 5)) for x in (rnd.choice(parts), rnd.choice(["\n", "\n", "\r\n", "\r", "\n\n"]))) for _ in range(600)]

    def kept(t):
        lines = [v for v in re.split(r"\r\n|\r|\n", t) if (low := v.strip(S.TRIM_CHARS).lower()) != "" and "not provided" not in low and not low.startswith("naics")]
        return "\n".join(lines).strip(S.TRIM_CHARS)

    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", description.clean_description("x").alias("c")).collect()
    assert [r.c for r in rows] == [kept(r.x) for r in rows]


def test_words_that_hold_others():
    assert text.distinct_words(["bid", "bids", "rfp", "rfp"]) == ["bid", "rfp"]
    assert text.distinct_words(["record", "land records", "archives"]) == ["record", "archives"]


def test_flatten_description(one):
    got = one(description.flatten_description("x"), x='{"z":{"b":[1,"x"]},"a":null,"t":true,"f":false,"s":"{\\"k\\":1}"}')
    assert got == 'z:\n  b:\n    0: 1\n    1: x\na: \nt: 1\nf: \ns: {"k":1}'
    deep = '{"a":[{"b":{"c":[1.50,{"d":{"e":true,"f":false,"g":null,"h":"[x"}}]}}],"z":2}'
    assert one(description.flatten_description("x"), x=deep) == (
        "a:\n  0:\n    b:\n      c:\n        0: 1.50\n        1:\n          d:\n            e: 1\n            f: \n            g: \n            h: [x\nz: 2"
    )
    assert one(description.flatten_description("x"), x="a\n\n\n\nb") == "a\n\nb"
    assert one(description.flatten_description("x"), x='[broken') == "[broken"


def test_description_pairs(spark):
    df = spark.createDataFrame([(1, "A: b: c\n\nplain\n:x")], "id int, DESCRIPTION string")
    got = [tuple(r)[1:] for r in description.description_pairs(df, "id").collect()]
    assert got == [(0, "A", "b: c"), (1, "", "plain"), (2, "", "x")]


@pytest.mark.parametrize(
    "code, desc, title, url, expected",
    [
        ("https://www.census.gov/naics/?input=541330&year=2022", "", "", "", "541330"),
        ("code 236220", "", "", "", "236220"),
        ("926199", "NAICS code: 926110", "", "", "926110"),
        ("Not provided", "our cloud", "", "", "541512"),
        ("", "", "lawn care", "", "561730"),
        ("", "call 5551234", "", "", "555123"),
        ("99", "", "", "", "921190"),
        (None, None, None, None, "921190"),
    ],
)
def test_naics(one, code, desc, title, url, expected):
    assert one(naics.normalize_naics("c", "d", "t", "u"), c=code, d=desc, t=title, u=url) == expected


@pytest.mark.parametrize(
    "field, desc, expected",
    [
        ("x; a.b@c-d.gov", "", "a.b@c-d.gov"),
        ("Not provided", "mail me at z@y.org.", "z@y.org"),
        ("bad@", "none", None),
        (None, "a@b..c and ok@d.us", "ok@d.us"),
    ],
)
def test_contact_email(one, field, desc, expected):
    assert one(contact.resolve_contact_email("f", "d"), f=field, d=desc) == expected


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Private  Company", "private_company"), ("corporate", "private_company"), ("GOV", "government"),
        ("county office", "government"), ("unknown", "uncertain"), (None, "uncertain"), ("not provided gov", "uncertain"),
    ],
)
def test_posting_entity(one, given, expected):
    assert one(contact.posting_entity("x"), x=given) == expected


def test_contact_block(one):
    address = contact.address_snippet("a")
    assert one(address, a=" 1 <b>Main</b>\t St \r\n\r\n Town") == "1 Main St\nTown"
    assert one(address, a="TBD\nTown") == ""
    block = contact.with_contact_block("d", address, contact.phone_snippet("p"))
    once = one(block, d="text", a="1 Main", p="n/a")
    assert once == "text\n\n---\n**Issuing entity — address & phone**\nAddress: 1 Main"
    assert one(block, d=once, a="1 Main", p="n/a") == once
    assert one(block, d="", a="", p="5") == "---\n**Issuing entity — address & phone**\nPhone: 5"


def test_titles(one):
    assert one(titles.corporate_prefix("t", "p"), t="Parts", p="private_company") == "Corporate: Parts"
    assert one(titles.corporate_prefix("t", "p"), t="corporate : Parts", p="private_company") == "corporate : Parts"
    assert one(titles.title_from_url("x"), x="https://a.gov/open-bids_now/123456789") == "Open Bids Now"
    assert one(titles.title_from_url("x"), x="https://a.gov/") == "Bidding Page"
    assert one(titles.title_from_url("x", "document"), x="https://a.gov/f/RFP%2012.pdf?x=1") == "Rfp 12.pdf"
    assert one(titles.title_from_url("x", "document"), x="https://a.gov") == "Document"


def test_public_link(one):
    def link(**kw):
        trust = kw.pop("trust", False)
        return one(titles.public_link("t", "i", "p", trust_local_id=trust), **kw)

    base = "/bids/ShowBid/"
    assert link(t="LRSI-0425(250) Guardrail", i="1", p="9") == base + "LRSI-0425-250--Guardrail-9"
    assert link(t="Hello World", i="4242", p=None, trust=True) == base + "Hello-World-4242"
    assert link(t="", i="7", p=None, trust=True) == base + "Unknown-7"
    assert link(t="A", i="5", p="999", trust=True) == base + "A-999"
    assert link(t="A", i="5", p="x9") is None


def test_labels(one):
    assert one(titles.source_label("n", "u"), n="Example County", u="https://example.gov/bids") == "Example County — https://example.gov/bids"
    assert one(titles.source_label("n", "u"), n="", u="https://e.gov") == "https://e.gov"
    assert one(titles.state_label("n", "u"), n="Ohio", u="oh") == "OH — Ohio"
    assert one(titles.entity_label(F.lit(3), ["n", "n"], ["u"]), n="A  B", u="X@y.gov") == "A B (#3) · x@y.gov"


@pytest.mark.parametrize(
    "given, expected",
    [
        ("2024-02-20 17:00", dt.date(2024, 2, 20)), ("2/5/2024", dt.date(2024, 2, 5)), ("March 5, 2024", dt.date(2024, 3, 5)),
        ("Mar 5, 2024", dt.date(2024, 3, 5)), ("5 March 2024", dt.date(2024, 3, 5)), ("2024-13-40", None), ("Not provided", None),
        ("13/45/2024", None),
    ],
)
def test_dates(one, given, expected):
    assert one(parse_day("x"), x=given) == expected


LONG = "w" * 130


@pytest.mark.parametrize(
    "title, desc, url, end, key, reason",
    [
        ("Road repair", LONG, "https://a.gov", None, False, "no_end_date_or_stable_key"),
        ("Road", LONG, "https://a.gov", "2024-01-01", False, "short_title"),
        ("Bidding Page", LONG, "https://a.gov", "2024-01-01", False, "generic_title"),
        ("RFP one", "", "https://a.gov", None, True, "keyword_in_title"),
        ("Road repair", "a tender", "https://a.gov", None, True, "keyword_in_description"),
        ("Road repair", "", "https://a.gov/bids", None, True, "keyword_in_url"),
        ("Road repair", "short", "https://a.gov", None, True, "thin_description"),
        ("Road repair", LONG + " watchguard", "https://a.gov", None, True, "blocked_phrase"),
        ("Road repair", LONG + " webs", "https://pr-webs-customer.des.wa.gov/x", None, True, "portal_rule"),
        ("Road repair", LONG, "https://a.gov", None, True, "substantial"),
    ],
)
def test_bid_like(one, title, desc, url, end, key, reason):
    v = records.classify_bid_like("t", "d", "u", parse_day("e"), F.lit(key))
    assert one(v, t=title, d=desc, u=url, e=end)["reason"] == reason


def brute_similar(a: bytes, b: bytes) -> int:
    """The longest common run, first one found, then left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best[0]:
                best = (n, i, j)
    n, i, j = best
    if not n:
        return 0
    return n + brute_similar(a[:i], b[:j]) + brute_similar(a[i + n:], b[j + n:])


def test_similarity():
    words = ["World", "Word", "city of rifle", "rifle city", "", "äöü", "aou", "abcabcabc", "cbacba", "water works 12"]
    for a in words:
        for b in words:
            x, y = a.encode(), b.encode()
            want = brute_similar(x, y) * 200.0 / (len(x) + len(y)) if x and y else 0.0
            assert abs(similar_percent(a, b) - want) < 1e-9


# ---------------------------------------------------------------- pages

HTML = (
    '<html><head><title>T &amp; U</title><style>a<b</style></head><body><nav><a href="/n">Nav link</a></nav>'
    '<p>Hello <b>bold</b>\n<!-- <p>no</p> -->&nbsp;end&copy;<p>two<a href="/d/RFP-12.pdf?x">Read the plan</a>'
    '<a href="{{ x }}.pdf">template</a><iframe src="//b.gov/addendum-2.pdf"></iframe></p><footer>foot</footer></body></html>'
)


def test_page_text_paths_agree(spark):
    rows = [(1, HTML), (2, "<p>a<p>b &eacute; &lt;c&gt;"), (3, "<div><nav>x<nav>y</nav>z</nav>w</div>"), (4, None), (5, "plain"),
            (6, "<script>if (a<b) {}</script>t"), (7, "<p title='a>b'>q</p>"), (8, "<p>é ü</p> \n <i>x</i>")]
    df = spark.createDataFrame(rows, "page_id int, html string")
    got = {r.page_id: r.text for r in pages.pages_to_text(df).collect()}
    for k, h in rows:
        assert got[k] == page_text(h), k
    assert got[1] == "T & UHello bold \u00a0end©twoRead the plantemplate"
    assert got[3] == "w"
    hard = {r.page_id: r.h for r in df.select("page_id", pages.needs_parser(F.coalesce("html", F.lit(""))).alias("h")).collect()}
    assert hard == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False, 7: True, 8: False}


def test_page_text_byte_limit(spark):
    df = spark.createDataFrame([(1, "<p>ééé</p>")], "page_id int, html string")
    assert pages.pages_to_text(df, max_bytes=6).first().text == "é"


def test_document_links(spark):
    df = spark.createDataFrame([(1, "https://a.gov/x/", HTML), (2, "https://a.gov/", "see http://c.gov/my-bid.pdf now")], "page_id int, url string, html string")
    got = {(r.page_id, r.TITLE, r.PDF_LINK) for r in pages.extract_document_links(df).collect()}
    assert got == {
        (1, "Read the plan", "https://a.gov/d/RFP-12.pdf?x"),
        (1, "Addendum 2.pdf", "https://b.gov/addendum-2.pdf"),
        (2, "My Bid.pdf", "http://c.gov/my-bid.pdf"),
    }


def test_detail_links(spark):
    html = (
        '<a href="/Bids/RFP-12.3-Bridge-Work"></a><a href="mailto:bid@a.gov">Send a bid</a><a href="#top">Bid top</a>'
        '<a href="https://x.bonfirehub.com/portal">Bids portal</a><a href="https://x.bonfirehub.com/opportunities/7">Opportunity 7</a>'
        '<a href="javascript:go()">Bid script</a><a href="/about">About us</a><a href="t/1">Tender one</a><a href="t/1">Tender again</a>'
        '<a href="https://procurement.opengov.com/portal/x?departmentId=1">Bids here</a>'
    )
    df = spark.createDataFrame([(1, "https://a.gov/list?x#y", html)], "page_id int, url string, html string")
    got = {(r.TITLE, r.URL) for r in pages.extract_detail_links(df).collect()}
    assert got == {
        ("Bid top", "https://a.gov/#top"),
        ("Bridge Work", "https://a.gov/Bids/RFP-12.3-Bridge-Work"),
        ("Opportunity 7", "https://x.bonfirehub.com/opportunities/7"),
        ("Tender one", "https://a.gov/t/1"),
    }


def test_near_text():
    got = page_links("<div>Outer words that are long enough<p>in <a href='x'>ab</a></p></div>")
    assert got == [(0, "a", "x", "ab", "Outer words that are long enoughin ab")]


@pytest.mark.parametrize(
    "html, text, url, expected",
    [
        ("<p>DOM is busy</p>", "Checking your browser", "https://a.gov", "blocked: browser check/captcha"),
        ("<p>x</p>", "Protected by Cloudflare", "https://a.gov", "blocked: cloudflare"),
        ("<input type='password'> Sign in", "Sign in", "https://a.gov", "login page"),
        ("<input type='password'> Sign in to see bids", "Sign in", "https://a.gov", "ok"),
        ("<p>x</p>", "There are no bids", "https://a.gov", "no open bids"),
        ("<p>x</p>", "There are no bids. 3 open solicitations", "https://a.gov", "ok"),
        ('<div id="root"></div>', "", "https://a.gov", "script shell"),
        ("<script>1</script>" * 3, "", "https://a.gov", "script shell"),
        ("<p>powered by Granicus</p>" + "x" * 300, "Closing date", "https://a.gov", "needs render"),
        ("<p>x</p>" + "x" * 300, "RFP 12-3", "https://a.gov/procurement/x", "needs render"),
        ("<a href='/Bids/1'>x</a>" + "x" * 300, "RFP 12-3", "https://a.gov/procurement/x", "ok"),
        ("<p>x</p>" + "x" * 300, "RFP 12-3", "https://city.BonfireHub.com/x", "needs render"),
        ("<p>x</p>" + "x" * 300, "RFP 12-3", "https://demandstar.com/x", "needs render"),
        ("<p>x</p>" + "x" * 300, "RFP 12-3", "https://notdemandstar.com/x", "ok"),
    ],
)
def test_classify_pages(spark, html, text, url, expected):
    df = spark.createDataFrame([(html, text, url)], "html string, text string, url string")
    assert pages.classify_pages(df).first().page_class == expected


def test_prioritize_links(spark):
    links = spark.createDataFrame([(1, 0, "One (a)", "u0"), (1, 1, "Two", "u1"), (1, 2, r"T\E3", "u2"), (1, 3, "", "u3")], "page_id int, pos int, TITLE string, URL string")
    text = "ONE (A) " + "x" * 500 + " status: open two " + "y" * 390 + "Status:\n Open t\\E3 Status: OPEN"
    listing = spark.createDataFrame([(1, text)], "page_id int, text string")
    got = [(r.pos, r.is_open) for r in pages.prioritize_links(links, listing, cap=3).orderBy("priority").collect()]
    assert got == [(1, True), (2, True), (0, False)]


def test_excerpt_budget_fits(spark):
    rows = [(i, "a", "x" * (100 * i + 7), "y" * 50, "") for i in range(1, 9)] + [(9, "b", "z" * 20, "", "")]
    df = spark.createDataFrame(rows, "page_id int, listing_url string, text string, html string, pdf_text string")
    got = pages.excerpt_budget(df, caps={"text": 500, "html": 40, "pdf_text": 10}, budget=1000).collect()
    assert sum(len(r.text) + len(r.html) for r in got if r.listing_url == "a") <= 1000
    assert [len(r.text) for r in got if r.listing_url == "b"] == [20]
