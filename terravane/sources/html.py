"""Listing pages in HTML: lists, details, linked data, by an Arrow UDF on the standard parser; plain cases by expressions."""

from __future__ import annotations

import html as escapes
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Node:
    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children, self.texts = tag, attributes, [], []

    def text(self) -> str:
        out: list[str] = []
        todo: list = list(reversed(self.texts))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo += reversed(x.texts)
            elif x.strip():
                out.append(x.strip())
        return re.sub(r"\s+", " ", " ".join(out))

    def walk(self):
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += reversed(n.children)

    def find(self, tag: str | None = None, **attributes: str):
        """Nodes by tag and by words of their attributes (``class_`` for class)."""
        for n in self.walk():
            if (tag is None or n.tag == tag) and all(v in n.attributes.get(k.rstrip("_"), "").split() for k, v in attributes.items()):
                yield n


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        self.open[-1].texts.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style") or self.open[-1].attributes.get("type") == "application/ld+json":
            self.open[-1].texts.append(data)


def parse(markup: str) -> Node:
    b = _Builder()
    b.feed(markup)
    b.close()
    return b.root


def id_in(url: str) -> str | None:
    m = re.search(r"-id(\d+)(?:$|[/?#])", url)
    return m and m[1]


def list_items(markup: str, item: str = "prop-info") -> list[dict]:
    """Blocks of a list page: url, title, address, price. Blocks without a link or without an id are skipped."""
    out = []
    for block in parse(markup).find(class_=item):
        link = next((a for a in block.find("a") if a.attributes.get("href")), None)
        if link is None or not id_in(link.attributes["href"]):
            continue
        part = lambda name: next((n.text() for n in block.find(class_=name)), None)  # noqa: E731, B023
        out.append({"url": link.attributes["href"], "title": part("prop-title") or link.text(), "address": part("prop-addr"), "price": part("price")})
    return out


def person_offer(root: Node) -> dict[str, str | None]:
    """Price, type and description of the offer in a page's linked data; the person is left out."""
    for script in root.find("script", type="application/ld+json"):
        try:
            data = json.loads("".join(t for t in script.texts if isinstance(t, str)))
        except ValueError:
            continue
        for entry in data if isinstance(data, list) else [data]:
            offer = entry.get("makesOffer") if isinstance(entry, dict) and entry.get("@type") == "Person" else None
            if isinstance(offer, dict):
                item = offer.get("itemOffered") if isinstance(offer.get("itemOffered"), dict) else {}
                text = lambda v: None if v is None else str(v)
                return {"price": text(offer.get("price")), "property_type": text(item.get("@type")), "description": text(offer.get("description") or item.get("description"))}
    return {"price": None, "property_type": None, "description": None}


def detail(markup: str, url: str) -> dict:
    """A detail page as a flat record; of two descriptions the longer stays."""
    root = parse(markup)
    offer = person_offer(root)
    first = lambda **a: next((n.text() for n in root.find(**a)), None)
    attributes = {}
    for block in root.find(class_="info-attr"):
        cells = [c.text() for c in block.children]
        if len(cells) >= 2 and cells[0]:
            attributes[cells[0].lower()] = cells[1]
    at = re.search(r"[?&](?:q|center|ll)=(-?\d+(?:\.\d+)?)(?:,|%2C)(-?\d+(?:\.\d+)?)", escapes.unescape(markup))
    return {
        "id": id_in(url),
        "title": first(tag="h1") or first(class_="title"),
        "address": first(class_="address"),
        "price": first(class_="price") or offer["price"],
        "property_type": offer["property_type"],
        "description": max(first(class_="info-content-body") or "", offer["description"] or "", key=len) or None,
        "attributes": attributes,
        "latitude": float(at[1]) if at else None,
        "longitude": float(at[2]) if at else None,
    }


def listing_blocks(markup: Column) -> Column:
    """Array of a list page's blocks; explode it for one row each."""

    @F.pandas_udf("array<struct<url:string,title:string,address:string,price:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([list_items(p) if p is not None else [] for p in pages])

    return run(markup)


def detail_record(markup: Column, url: Column) -> Column:
    """Struct of a detail page."""
    kind = "id string, title string, address string, price string, property_type string, description string, attributes map<string,string>, latitude double, longitude double"

    @F.pandas_udf(kind)
    def run(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detail(p or "", u or "") for p, u in zip(pages, urls, strict=True)], columns=["id", "title", "address", "price", "property_type", "description", "attributes", "latitude", "longitude"])

    return run(markup, url)


def plain_text(markup: Column) -> Column:
    """Text without tags, single-spaced; scripts and styles are left out."""
    bare = F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"\s+", " "))


def title(markup: Column) -> Column:
    return F.trim(F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(markup: Column) -> Column:
    return F.regexp_count(markup, F.lit(r"(?i)<a\s"))
