"""EPUB containers: spine, table of contents and metadata, by the standard zip and XML readers. Pure functions."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from posixpath import dirname, join, normpath
from typing import Any
from urllib.parse import unquote

NS = {
    "c": "urn:oasis:names:tc:opendocument:xmlns:container",
    "o": "http://www.idpf.org/2007/opf",
    "d": "http://purl.org/dc/elements/1.1/",
    "n": "http://www.daisy.org/z3986/2005/ncx/",
    "x": "http://www.w3.org/1999/xhtml",
    "e": "http://www.idpf.org/2007/ops",
}


def opened(data: bytes) -> tuple[zipfile.ZipFile, ET.Element, str]:
    """(archive, package document, its folder)."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = ET.fromstring(z.read("META-INF/container.xml"))
    path = root.find(".//c:rootfile", NS).attrib["full-path"]
    return z, ET.fromstring(z.read(path)), dirname(path)


def _texts(package: ET.Element, name: str) -> list[str]:
    return [t for t in ((e.text or "").strip() for e in package.findall(f".//d:{name}", NS)) if t]


def metadata(package: ET.Element) -> dict[str, Any]:
    """title, authors, language, dates and year: the first year of the twentieth or twenty-first century."""
    dates = _texts(package, "date")
    year = next((m.group() for m in (re.search(r"(?:19|20)\d{2}", d) for d in dates) if m), "")
    first = lambda name: next(iter(_texts(package, name)), "")
    return {"title": first("title"), "authors": _texts(package, "creator"), "language": first("language"), "dates": dates, "year": year}


def items(data: bytes) -> Iterator[dict[str, Any]]:
    """The items of a book: pos (place in the spine, null outside), id, href within the container, media type, properties, content."""
    z, package, folder = opened(data)
    spine = {e.attrib["idref"]: i for i, e in enumerate(package.findall(".//o:spine/o:itemref", NS))}
    names = set(z.namelist())
    for e in package.findall(".//o:manifest/o:item", NS):
        href = normpath(join(folder, unquote(e.attrib["href"])))
        yield {
            "spine_pos": spine.get(e.attrib["id"]), "id": e.attrib["id"], "href": href, "media_type": e.attrib.get("media-type", ""),
            "properties": e.attrib.get("properties", ""), "content": z.read(href) if href in names else None,
        }


def flattened(node: dict[str, Any]) -> Iterator[tuple[str, str]]:
    """(title, href) of a nested table of contents, depth first; nodes without a link give only what is below them."""
    if node.get("href"):
        yield node.get("title", ""), node["href"]
    for child in node.get("children", ()):
        yield from flattened(child)


def contents(data: bytes) -> list[tuple[str, str]]:
    """The table of contents, by the navigation page or else the NCX."""
    z, package, folder = opened(data)
    out: list[tuple[str, str]] = []
    manifest = package.findall(".//o:manifest/o:item", NS)
    nav = next((e for e in manifest if "nav" in e.attrib.get("properties", "").split()), None)
    if nav is not None:
        path = normpath(join(folder, unquote(nav.attrib["href"])))
        root = ET.fromstring(z.read(path))
        for block in root.iter(f"{{{NS['x']}}}nav"):
            if block.attrib.get(f"{{{NS['e']}}}type", "toc") == "toc":
                for a in block.iter(f"{{{NS['x']}}}a"):
                    if a.attrib.get("href"):
                        out.append((" ".join("".join(a.itertext()).split()), normpath(join(dirname(path), unquote(a.attrib["href"])))))
                break
    ncx = next((e for e in manifest if e.attrib.get("media-type") == "application/x-dtbncx+xml"), None)
    if not out and ncx is not None:
        path = normpath(join(folder, unquote(ncx.attrib["href"])))

        def node(e: ET.Element) -> dict[str, Any]:
            label, link = e.find("n:navLabel/n:text", NS), e.find("n:content", NS)
            return {
                "title": " ".join((label.text or "").split()) if label is not None else "",
                "href": normpath(join(dirname(path), unquote(link.attrib["src"]))) if link is not None and link.attrib.get("src") else "",
                "children": [node(c) for c in e.findall("n:navPoint", NS)],
            }

        for point in ET.fromstring(z.read(path)).findall(".//n:navMap/n:navPoint", NS):
            out.extend(flattened(node(point)))
    return out


def cover(data: bytes) -> dict[str, Any] | None:
    """The cover image: named by the package, marked as such, called so, or else the largest image."""
    _, package, _ = opened(data)
    named = next((e.attrib.get("content", "") for e in package.findall(".//o:metadata/o:meta", NS) if e.attrib.get("name") == "cover"), "")
    images = [x for x in items(data) if x["media_type"].startswith("image/") and x["content"]]

    def rank(x: dict[str, Any]) -> tuple[int, int]:
        called = "cover" in x["href"].lower() or "cover" in x["id"].lower()
        place = 0 if named and named in (x["id"], x["href"]) else 1 if "cover-image" in x["properties"].split() else 2 if called else 3
        return place, -len(x["content"])

    return min(images, key=rank, default=None)
