"""Extraction from random pages: from built ones whose rows are known, and from broken ones."""

import random

from leafmill.operators.extract import extract_all
from leafmill.schema import FAMILIES

BASE = "https://h.example/"
LONG = "a long text of more than thirty characters"


class Builder:
    """Writes a page block by block and notes the rows that each block stands for."""

    def __init__(self, rng):
        self.rng, self.rows, self.links, self.number, self.tables = rng, [], set(), 0, -1

    def word(self):
        self.number += 1
        return f"{self.rng.choice(['alpha', 'beta', 'gamma'])}{self.number}"

    def some(self):
        return self.rng.random() < 0.6

    def row(self, family, type_, text, order=0, **fields):
        fields.setdefault("href", "")
        key = (FAMILIES[family], order, len(self.rows))
        self.rows.append((key, {"family_rank": FAMILIES[family], "source": "h.example", "type": type_, "text": text, **fields}))

    def link(self, inner, written):
        """An `a` element; it is a link row of its own wherever it stands."""
        if (inner, written) not in self.links and len(inner) > 2:
            self.links.add((inner, written))
            self.row("links", "link", inner, href=BASE + written)
        return f'<a href="{written}">{inner}</a>'

    def heading(self, level, inner, cls=""):
        if len(inner) > 2:
            self.row("headings", f"heading_h{level}", inner, order=level)
        return f"<h{level}{cls}>{inner}</h{level}>"

    def quote(self):
        text, out = self.word(), '<div class="quote">'
        author = self.word() if self.some() else ""
        tags = [self.word() for _ in range(self.rng.randrange(3))]
        out += f'<span class="text"> {text} </span>' + (f'<small class="author">{author}</small>' if author else "")
        out += "".join(f'<a class="tag">{t}</a>' for t in tags) + "</div>"
        self.row("quotes", "quote", text, author=author, tags=", ".join(tags))
        return out

    def book(self):
        title, linked, rated = self.word(), self.some(), self.some()
        price, written = self.word(), f"b{self.number}"
        self.row("books", "book", title, href=written if linked else "", price=price, rating="Two" if rated else "")
        inner = self.link(title, written) if linked else title
        self.row("headings", "heading_h3", title, order=3)
        stars = '<p class="star-rating Two"></p>' if rated else ""
        return f'<article class="product_pod">{stars}<h3>{inner}</h3><p class="price_color">{price}</p></article>'

    def job(self):
        title, company, place, day = self.word(), self.word(), self.word(), self.word() if self.some() else ""
        self.row("jobs", "job", title, company=company, location=place, posted=day)
        return (
            '<div class="card-content">' + self.heading(2, title, ' class="title"') + self.heading(3, company, ' class="company"')
            + f'<p class="location">{place}</p>' + (f"<time>{day}</time>" if day else "") + "</div>"
        )

    def product(self):
        title, price, stars = self.word(), self.word(), self.rng.randrange(4)
        about = self.word() if self.some() else ""
        written = f"p{self.number}"
        self.row("products", "product", title, href=written, price=price, description=about, rating=str(stars))
        out = '<div class="thumbnail">' + self.heading(4, price, ' class="price"')
        out += f'<a class="title" href="{written}">{title}</a>' + (f'<p class="description">{about}</p>' if about else "")
        self.link(title, written)
        return out + '<div class="ratings">' + '<span class="ws-icon-star"></span>' * stars + "</div></div>"

    def story(self):
        title, detailed, index = self.word(), self.some(), self.next_table()
        written = f"n{self.number}"
        score, age = (self.word(), self.word()) if detailed else ("", "")
        self.row("news", "news_story", title, href=written, score=score, age=age)
        self.cells(index, {"col_0": title, "col_0_link": written})
        out = '<table><tr class="athing"><td><span class="titleline">' + self.link(title, written) + "</span></td></tr>"
        if detailed:
            self.cells(index, {"col_0": f"{score} {age}"})
            out += f'<tr><td><span class="score">{score}</span> <span class="age">{age}</span></td></tr>'
        return out + "</table>"

    def next_table(self):
        self.tables += 1
        return self.tables

    def cells(self, index, cells):
        if index < 10:  # later tables are not read
            self.row("tables", "table_row", cells.get("text"), href=None, table_index=index, cells=cells)

    def grid(self):
        names, index = [self.rng.choice(["text", "price", "name", "size"]) for _ in range(self.rng.randint(1, 3))], self.next_table()
        out = "<table><tr>" + "".join(f"<th>{n}</th>" for n in names) + "</tr>"
        self.cells(index, {n: n for n in names})
        for _ in range(self.rng.randrange(3)):
            values = [self.word() for _ in range(self.rng.randint(1, 4))]
            self.cells(index, {names[i] if i < len(names) else f"col_{i}": v for i, v in enumerate(values)})
            out += "<tr>" + "".join(f"<td>{v}</td>" for v in values) + "</tr>"
        return out + "</table>"

    def paragraph(self):
        text = f"{LONG} {self.word()}" if self.some() else self.word()
        if len(text) > 30:
            self.row("paragraphs", "paragraph", text)
        return f"<p>{text}</p>"

    def plain_heading(self):
        return self.heading(self.rng.randint(1, 6), self.rng.choice(["ab", self.word()]))

    def plain_link(self):
        return f"<div>{self.link(self.rng.choice(['ab', 'again', self.word()]), self.rng.choice(['u', 'v']))}</div>"

    def items(self):
        navigation, out = self.rng.random() < 0.3, []
        for _ in range(self.rng.randint(1, 4)):
            text, written = f"item {self.word()}", f"l{self.number}" if self.some() else ""
            if self.rng.random() < 0.2:
                text, written = "short", ""
            if not navigation and len(text) > 10:
                self.row("lists", "list_item", text, href=written)
            out.append(f"<li>{self.link(text, written) if written else text}</li>")
        kind = self.rng.choice(["ul", "ol"])
        return f"<div class=\"{'top-Nav' if navigation else 'box'}\"><{kind}>{''.join(out)}</{kind}></div>"

    def page(self):
        head = ""
        if self.some():
            title = self.word()
            self.row("metadata", "page_title", title)
            head += f"<title> {title}\n</title>"
        if self.some():
            author = self.word()
            self.row("metadata", "meta_author", author)
            head += f'<meta name="Author" content="{author}">'
        blocks = [
            self.quote, self.book, self.job, self.product, self.story, self.grid, self.paragraph,
            self.plain_heading, self.plain_link, self.items,
        ]
        body = "".join(self.rng.choice(blocks)() for _ in range(self.rng.randint(1, 25)))
        return f"<html><head>{head}</head><body>{body}</body></html>"


def found_on(spark, htmls):
    frame = spark.createDataFrame([(i, BASE, h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    found = {}
    for r in extract_all(frame).orderBy("page_id", "pos").collect():
        found.setdefault(r["page_id"], []).append(
            {k: v for k, v in r.asDict().items() if v is not None and k not in ("page_id", "url", "page_ord")}
        )
    return found


def test_built_pages(spark):
    """Every block yields its rows, family by family, in the order of the page."""
    builders = [Builder(random.Random(i)) for i in range(300)]
    found, kinds = found_on(spark, [b.page() for b in builders]), set()
    for i, builder in enumerate(builders):
        rows = []
        for _, row in sorted(builder.rows, key=lambda r: r[0]):
            row = {k: v for k, v in row.items() if v is not None}
            row |= {k: v for k, v in row.get("cells", {}).items() if k in ("text", "price")}
            rows.append(row)
        got = [{k: v for k, v in r.items() if k != "pos"} for r in found.get(i, [])]
        assert got == rows, i
        kinds |= {r["family_rank"] for r in rows}
    assert kinds == set(FAMILIES.values())


PARTS = (
    "<table> <tr> <td> <th> <ul> <ol> <li> <p> <h1> <h2> <h4> <div> <b> <i> <a> <time> <title> </table> </tr>"
    " </td> </ul> </li> </p> </div> </a> </span> </h2> </title> <a|href=u> <a|href='/v'> <div|class=quote>"
    " <span|class=text> <article|class=product_pod> <div|class=card-content> <h2|class=title> <tr|class=athing>"
    " <div|class=thumbnail> <a|class=title|href=t> <span|class=titleline> <meta|name=Author|content=me> <!-- <! &amp"
).split()


def test_broken_pages(spark):
    """Whatever the markup, rows keep to the rules of their family."""
    rng = random.Random(11)
    htmls = [
        "".join(rng.choice(PARTS).replace("|", " ") if rng.random() < 0.7 else rng.choice(["x", " ab ", LONG, "\n"])
                for _ in range(rng.randint(5, 120)))
        for _ in range(400)
    ]
    found = found_on(spark, htmls)
    least = {"paragraph": 31, "link": 3, "list_item": 11}
    for i, rows in found.items():
        assert [r["pos"] for r in rows] == list(range(len(rows)))
        assert [r["family_rank"] for r in rows] == sorted(r["family_rank"] for r in rows)
        links = [(r["text"], r["href"]) for r in rows if r["type"] == "link"]
        assert len(links) == len(set(links)), htmls[i]
        assert sum(r["type"] == "page_title" for r in rows) <= 1
        for r in rows:
            assert len(r.get("text", "")) >= (3 if r["type"].startswith("heading_") else least.get(r["type"], 0))
            assert r["type"] != "table_row" or (r["cells"] and r["table_index"] < 10)
            assert r["type"] != "link" or r["href"].startswith(BASE)
    assert {r["type"] for rows in found.values() for r in rows} >= {*least, "page_title", "meta_author", "quote", "job"}
