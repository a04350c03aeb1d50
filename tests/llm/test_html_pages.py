"""Pages written by hand, in layouts that no built page was taken from: what must come out and what must not."""

import pytest

from packetlake.llm import html_extract as he

A = "The old mill stood at the bend of the river for more than two hundred years before the flood took its roof and half of the eastern wall."
B = "Nobody in the village remembered who had built it, but the stones carried the marks of three different masons and one of them was a woman."
C = "When the water went down, the council decided to keep what was left and to plant a garden between the walls, where children now play in summer."
D = "The garden opened last week with music, soup for everyone and a long speech that most people did not hear because of the wind."
N = '<a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a>'
PAGES = {
    "opaque box, real aside and footer": (f"<body><div class=g1><h2>The mill garden</h2><p>{A}</p><p>{B}</p><p>{C}</p></div><aside><p>About the author</p></aside><footer><p>Copyright 2021 by the paper</p></footer></body>", [A, B, C], ["Copyright"]),
    "line breaks": (f"<html><body><div>{A}<br><br>{B}<br><br>{C}</div></body></html>", [A, B, C], []),
    "line breaks, menu and footer": (f"<body><div>{N}</div><div>{A}<br><br>{B}<br><br>{C} {D}</div><div>Copyright 2020</div></body>", [A, C, D], []),
    "table layout": (f"<body><table><tr><td>{N}</td></tr><tr><td><h1>The mill</h1><p>{A}</p><p>{B}</p><p>{C}</p></td></tr><tr><td>Copyright 1999</td></tr></table></body>", [A, B, C], ["Home"]),
    "no classes": (f"<body><ul><li><a href=/>Home</a></li><li><a href=/b>Blog</a></li></ul><h1>The mill</h1><p>{A}</p><p>{B}</p><p>{D}</p><p><a href=/p>Privacy policy</a></p></body>", [A, B, D], ["Home", "Blog"]),
    "comments": (f"<body><nav>{N}</nav><article><h1>The mill</h1><p>{A}</p><p>{B}</p></article><section class=comments><p>Great read, thank you!</p><p>I was there too.</p></section></body>", [A, B], ["Home", "Great read"]),
    "one paragraph": (f"<p>{A} {B}</p>", [A], []),
    "main with sidebar": (f"<body><header>{N}</header><main><h1>The mill</h1><p>{A}</p><p>{C}</p><p>{D}</p></main><div class=sidebar><h3>Related</h3><ul><li><a href=1>Ten best soups</a></li><li><a href=2>Wind tonight</a></li></ul></div><footer>Imprint Contact</footer></body>", [A, C, D], ["Ten best soups", "Imprint"]),
    "sections of made-up names": (f"<body><div class=q7><a href=1>Start</a> <a href=2>Shop</a></div><div class=k2><div class=z1><h1>The mill</h1></div><div class=z2><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div></div><div class=q9><p>All rights reserved</p></div></body>", [A, B, C, D], ["Shop"]),
    "cookie notice first": (f"<body><div class='cookie-notice'><p>We use cookies.</p><button>Accept</button></div><div id=content><h1>The mill</h1><p>{A}</p><p>{B}</p></div><footer><a href=/x>Terms</a></footer></body>", [A, B], ["cookies"]),
    "list article": (f"<body><nav>{N}</nav><div class=post><h1>Four things</h1><ol><li>{A}</li><li>{B}</li><li>{C}</li></ol></div><footer>Copyright</footer></body>", [A, B, C], ["Home"]),
    "form and login": (f"<body><form class=search><input><button>Search</button></form><div class=entry><p>{B}</p><p>{C}</p><p>{D}</p></div><form><label>Name</label><button>Log in</button></form></body>", [B, C, D], ["Log in"]),
}


@pytest.fixture(scope="module")
def texts(spark):
    model = he.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rows = spark.createDataFrame([(k, name, page) for k, (name, (page, *_)) in enumerate(PAGES.items())], "page_id long, url string, html string")
    return {r.url: r.text for r in he.extract(rows, model).collect()}


def test_articles_come_out_and_the_rest_mostly_stays_away(texts):
    wrong, kept, wanted = [], 0, 0
    for name, (_, yes, no) in PAGES.items():
        got = texts[name]
        kept += sum(len(x) for x in yes if x in got)
        wanted += sum(map(len, yes))
        wrong += [(name, "lost", x[:30]) for x in yes if x not in got] + [(name, "kept", x) for x in no if x in got]
    print(f"{kept} of {wanted} characters; {wrong}")
    assert kept >= 0.95 * wanted and sum(w[1] == "kept" for w in wrong) <= 3, wrong
