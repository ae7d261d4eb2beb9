import datetime as dt
import tempfile

from courtside.sources import pages as PG
from courtside.sources import snapshot as SN
from tests.conftest import rows


def test_refresh_snapshot_versions(spark):
    root = tempfile.mkdtemp(prefix="courtside-snap-")
    path = f"{root}/snap"
    v1 = spark.createDataFrame([(1, "a")], "id long, s string")
    v2 = spark.createDataFrame([(2, "b")], "id long, s string")
    first = SN.refresh_snapshot(spark, v1, path, max_age_hours=8)
    assert rows(first) == [(1, "a")]
    # fresh: the source is not read again
    again = SN.refresh_snapshot(spark, lambda: (_ for _ in ()).throw(AssertionError("read")), path)
    assert rows(again) == [(1, "a")]
    # inactive season: never refreshed even when old
    later = dt.datetime.now(dt.timezone.utc) + dt.timedelta(hours=9)
    assert rows(SN.refresh_snapshot(spark, v2, path, active=False, now=later)) == [(1, "a")]
    # stale and active: a new version is written and read
    assert rows(SN.refresh_snapshot(spark, v2, path, now=later)) == [(2, "b")]
    assert SN.snapshot_versions(spark, path).count() == 2


def test_csv_roundtrip(spark):
    root = tempfile.mkdtemp(prefix="courtside-csv-")
    df = spark.createDataFrame([("Dončić", "$1,000"), ("Jokić", "")], "player string, salary string")
    SN.write_table(df, f"{root}/c", fmt="csv")
    back = SN.read_csv_table(spark, f"{root}/c", "player string, salary string")
    assert rows(back) == [("Dončić", "$1,000"), ("Jokić", None)]


def test_page_extraction(spark):
    html = ("<ul><li><a href=\"/x\">First item</a></li><li><a href=\"/y\">G-League move</a></li>"
            "<li><a href=\"/z\">December 22, 2020</a></li></ul><!-- <table><tr><th>Team</th><th>W</th></tr>"
            "<tr><td>A</td><td>3</td></tr></table> -->")
    pages = spark.createDataFrame([(1, "u", html), (2, "v", "<p>none</p>")], "page_id long, url string, html string")
    items = PG.extract_list_items(pages)
    assert rows(items) == [(1, 0, "First item"), (1, 2, "December 22, 2020")]
    odd = spark.createDataFrame([(3, "<ul><LI class='x'>plain</LI>\n<li>two <b>bold</b>\nlines</li><link rel=a></ul><!-- a\nb --><!---->")],
                                "page_id long, html string")
    assert rows(PG.extract_list_items(odd), "item") == [("plain",), ("two bold\nlines",)]
    assert rows(PG.comment_blocks(odd), "body") == sorted([("",), (" a\nb ",)], key=repr)
    dated = PG.extract_list_items(pages, date_format="MMMM d, yyyy", since="2020-12-01")
    assert rows(dated, "item") == [("December 22, 2020",)]
    blocks = PG.comment_blocks(pages)
    assert blocks.count() == 1
    cells = PG.table_cells(blocks.withColumnRenamed("body", "html"), 2)
    assert rows(cells, "row", "col", "text") == [(0, 0, "Team"), (0, 1, "W"), (1, 0, "A"), (1, 1, "3")]


TABLE = """<p>x</p></table><table id=a><thead><tr><th rowspan="2">Rk</th><th rowspan=2>Team</th><th colspan='2'>Rating</th></tr><tr><th>W</th><th>L</th></tr></thead>
<tr><td>1<td><a href='/t'>A &amp;lt; B</a> <TABLE><tr><td>in</td></tr></table> tail</td><td>3 < 4</td><td></td></tr><!-- <td>no</td> -->
<tr><th>Rk</th><th>Team</th><th>W</th><th>L</th></tr><tr><td rowspan=3>2</td><td>C</td><td>5</td></tr><tr><td>D</td><td>6</td><td>7</td></tr>
<tr></tr></table>after<table><tr><td>solo</td></tr>"""


def grids(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    return [[[c.text for c in line] for line in r.lines] for r in PG.page_grids(df).orderBy("table").collect()]


def test_tables_by_their_tags(spark):
    """Nesting, missing and stray end tags, spans, comments, references, text outside."""
    head = [["Rk", "Team", "Rating", "Rating"], ["Rk", "Team", "W", "L"]]
    assert grids(spark, TABLE) == [
        [*head, ["1", "A &lt; B tail", "3 < 4", ""], ["Rk", "Team", "W", "L"], ["2", "C", "5"], ["2", "D", "6", "7"]], [["in"]], [["solo"]]]
    pages = spark.createDataFrame([(1, TABLE), (2, None), (3, ""), (4, "<p>no <td>table</td></p>")], "page_id long, html string")
    records = PG.page_table_records(pages, {"team": "Team", "l": "L"})
    assert rows(records, "page_id", "row", "team", "l") == sorted([(1, 2, "A &lt; B tail", ""), (1, 4, "C", None), (1, 5, "D", "7")], key=repr)
    assert PG.page_table_records(pages, {"x": "it's not there"}).count() == 0
    cells = PG.page_table_cells(pages)
    assert cells.columns == ["page_id", "table", "row", "col", "text", "head"] and cells.where("head").count() == 12


def test_spans_on_the_grid(spark):
    assert grids(spark, "<table><tr><td rowspan=2>a<td>b<td rowspan=3>c<tr><td>d<tr><td>e<td>f<td>g<tr><td>h</table>") == [
        [["a", "b", "c"], ["a", "d", "c"], ["e", "f", "c", "g"], ["h"]]]
    assert grids(spark, "<table><tr><td colspan=2 rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>") == [[["a", "a", "b"], ["a", "a", "c"], ["d", "e"]]]
    assert grids(spark, "<table><tr><td colspan=0>a<td rowspan='x'>b</table>") == [[["a", "b"]]]
    assert len(grids(spark, "<table><tr><td colspan=99999>a</table>")[0][0]) == 1000


def test_long_tables(spark):
    """A cell that spans more rows than 1,000 stands in all of them, and pages
    are read where they lie: no shuffle, no rows of single tags."""
    from courtside.plans import schedule as S
    head = "".join(f"<th>{x}</th>" for x in ("Date", "Game", "Start (ET)", "Visitor/Neutral", "PTS", "Home/Neutral"))
    lines = "".join(f"<tr>{'<th rowspan=2500>Tue, Dec 22, 2020</th>' if i == 0 else ''}<td>{i}<td>7:30p<td>1<td><td>2</tr>" for i in range(2500))
    pages = spark.createDataFrame([(1, f"<table><tr>{head}</tr>{lines}</table>")], "page_id long, html string")
    got = S.schedule_from_pages(pages, "2020-12-01").select("game_no", "game_id", "start_minute", "visitor", "home").orderBy("game_no").collect()
    assert [tuple(r) for r in got] == [(i + 1, i, 1170, 1, 2) for i in range(2500)]
    plan = PG.page_grids(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_pages_that_repeat_an_id(spark):
    """Each is read on its own, like the SQL does."""
    one = "<table><tr><th>A<th>B</tr><tr><td>1<td>2</tr></table>"
    pages = spark.createDataFrame([(1, one), (1, one), (None, one), (None, one.replace("1", "3"))], "page_id long, html string").repartition(2)
    got = PG.page_table_records(pages, {"a": "A", "b": "B"})
    assert rows(got, "page_id", "row", "a", "b") == sorted([(1, 1, "1", "2"), (1, 1, "1", "2"), (None, 1, "1", "2"), (None, 1, "3", "2")], key=repr)


def test_tables_against_a_plain_reader(spark):
    """Random tables without spans, some nested, by the standard library's parser."""
    import random
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.done, self.open = [], []

        def handle_starttag(self, tag, attrs):
            if tag == "table":
                self.open.append([len(self.done), []])
                self.done.append(None)
            elif self.open and tag == "tr":
                self.open[-1][1].append([])
            elif self.open and tag in ("td", "th"):
                self.open[-1][1][-1].append("")

        def handle_endtag(self, tag):
            if tag == "table" and self.open:
                at, lines = self.open.pop()
                self.done[at] = [[" ".join(c.split()) for c in line] for line in lines if line]

        def handle_data(self, data):
            if self.open and self.open[-1][1] and self.open[-1][1][-1]:
                self.open[-1][1][-1][-1] += data

    rng = random.Random(9)

    def table(depth):
        def cell():
            inner = table(depth + 1) if depth < 3 and rng.random() < 0.15 else ""
            return rng.choice(["<td>", "<th class='x'>", "<TD\n>"]) + rng.choice(["", "a b", "  7 ", "<b>x</b>\ny"]) + inner + rng.choice(["", " z"])
        body = "".join("<tr>" + "".join(cell() for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(0, 5)))
        return f"<table>{body}</table>"

    pages = [(i, "".join(rng.choice(["text ", "<p>"]) + table(0) for _ in range(rng.randint(0, 3)))) for i in range(60)]
    want = {}
    for i, html in pages:
        reader = Reader()
        reader.feed(html)
        want[i] = [t for t in reader.done if t]
    got = {i: [] for i, _ in pages}
    for r in PG.page_grids(spark.createDataFrame(pages, "page_id long, html string").repartition(3)).orderBy("page_id", "table").collect():
        got[r.page_id].append([[c.text for c in line] for line in r.lines])
    assert got == want


def test_hidden_tables_to_ratings(spark):
    from courtside.plans import schedule as S
    html = ("<p>a</p><!-- <table><tr><th>Team<th>W<th>L<th>Pace<th>ORtg<th>DRtg<th>NRtg</tr><tr><td>One*<td>3<td>4<td>99.5<td>110<td>108.5<td>+1.5</tr>"
            "<tr><td>League Average<td>1<td>1<td>1<td>1<td>1<td>1</tr></table> --><!-- plain -->")
    pages = spark.createDataFrame([(5, html), (6, "<p>nothing</p>")], "page_id long, html string")
    teams = spark.createDataFrame([(11, "One", "E")], "team long, full_name string, conference string")
    assert [tuple(r) for r in S.ratings_from_pages(pages, teams).collect()] == [(5, 11, "One", 3, 4, 99.5, 110.0, 108.5, 1.5)]
