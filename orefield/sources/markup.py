"""HTML pages, TEI documents, provider JSON and raw files as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from orefield.functions import text as T
from orefield.operators import relational as R
from orefield.session import ship, spread


def html_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages without the markup, plus title, lang, n_paragraphs and headings."""
    c = F.coalesce(F.col(html), F.lit(""))
    return pages.select(
        *(x for x in pages.columns if x != html),
        F.regexp_extract(c, r"<title>([^<]*)</title>", 1).alias("title"),
        F.regexp_extract(c, r'<html[^>]*lang="([^"]*)"', 1).alias("lang"),
        F.size(F.regexp_extract_all(c, F.lit(r"(<p[ >])"), F.lit(1))).cast("long").alias("n_paragraphs"),
        F.regexp_extract_all(c, F.lit(r"<h[1-6][^>]*>([^<]*)</h[1-6]>"), F.lit(1)).alias("headings"),
    )


def _texts(xml: Column, path: str) -> Column:
    return F.transform(F.xpath(xml, F.lit(path)), lambda x: F.trim(x))


def _first(xml: Column, *paths: str) -> Column:
    return F.coalesce(*(T.non_empty(F.trim(F.xpath_string(xml, F.lit(p)))) for p in paths))


_REFERENCES = "array<struct<title:string,authors:array<string>,date:string,doi:string,journal:string>>"
_NODES = f"title string, doi string, authors array<string>, affiliations array<string>, abstract array<string>, sections array<struct<title:string,text:string>>, references {_REFERENCES}, formulas array<string>"


def tei(docs: DataFrame, xml: str = "xml") -> DataFrame:
    """docs plus title, doi, authors, affiliations, abstract, sections array<struct<title,text>>, references and formulas.

    Each document is parsed once; one that isn't well-formed is an error. Prefixes of names count as parts of them.
    """
    ship(docs.sparkSession)
    kept = [f for f in docs.schema if f.name != xml]
    kinds = to_arrow_schema(StructType.fromDDL(_NODES))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), _NODES.replace("references", "`references`")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_nodes(t.as_py()) for t in batch.column(len(kept))]
            made = [pa.array([n.get(k.name) for n in found], k.type) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *made], names=[*(f.name for f in kept), *kinds.names])

    out = spread(docs).select(*(f.name for f in kept), xml).mapInArrow(run, fields)
    refs = F.transform("references", lambda r: F.struct(r["title"], r["authors"], R.year_of(r["date"]).alias("year"), r["doi"], r["journal"]))
    return out.withColumns({
        "affiliations": F.array_distinct(F.transform("affiliations", T.squeeze)),
        "abstract": T.non_empty(F.array_join("abstract", "\n\n")),
        "references": refs,
    })


def _nodes(xml: str | None) -> dict:
    """The fields of one document by one pass over its elements; a text ends at every tag, comment and instruction."""
    if not xml:
        return {} if xml is None else {"authors": [], "sections": [], "references": []}
    authors, divs, refs, path, buffer = [], [], [], [], []
    lists: dict[str, list[str]] = {"affiliations": [], "abstract": [], "formulas": []}
    head: dict[str, str] = {}
    # Depths of the open element of each kind; elements of its name within it belong to it.
    depth: dict[str, int] = {}

    def text() -> None:
        if not buffer:
            return
        t, (name, attrs) = "".join(buffer).strip(" "), path[-1]
        buffer.clear()
        up = path[-2][0] if len(path) > 1 else ""
        inner = lambda kind: [n for n, _ in path[depth[kind] :]] if kind in depth else None
        if name == "title":
            for record in (head, refs[-1]) if "biblStruct" in depth else (head,):
                record.setdefault(f"title {attrs.get('level')}", t)
            head.setdefault("title", t)
        elif name == "idno" and attrs.get("type") == "DOI":
            for record in (head, refs[-1]) if "biblStruct" in depth else (head,):
                record.setdefault("doi", t)
        elif name == "forename" and inner("author") == ["persName", "forename"]:
            authors[-1][0].append(t)
        elif name == "surname":
            if inner("author") == ["persName", "surname"]:
                authors[-1][1].append(t)
            if "biblStruct" in depth and [n for n, _ in path[-3:-1]] == ["author", "persName"] and len(path) - 2 > depth["biblStruct"]:
                refs[-1]["authors"].append(t)
        elif name == "affiliation" and up == "author":
            lists["affiliations"].append(t)
        elif name == "formula" and t:
            lists["formulas"].append(t)
        elif name == "head" and inner("div") == ["head"]:
            divs[-1].setdefault("title", t)
        elif name == "p":
            if any(n == "abstract" for n, _ in path):
                lists["abstract"].append(t)
            if inner("div") == ["p"]:
                divs[-1]["text"].append(t)

    def start(name: str, attrs: dict[str, str]) -> None:
        text()
        path.append((name, attrs))
        if name == "date" and "when" in attrs and "biblStruct" in depth:
            refs[-1].setdefault("date", attrs["when"])
        if name in ("author", "biblStruct", "body", "div") and name not in depth and (name != "div" or "body" in depth):
            depth[name] = len(path)
            if name == "author":
                authors.append(([], []))
            elif name == "div":
                divs.append({"text": []})
            elif name == "biblStruct":
                refs.append({"authors": []})

    def end(name: str) -> None:
        text()
        if depth.get(name) == len(path):
            del depth[name]
        path.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, buffer.append
    parser.CommentHandler, parser.ProcessingInstructionHandler = lambda _: text(), lambda *_: text()
    parser.Parse(xml, True)
    names = (" ".join(t for t in [*first, *last] if t).strip(" ") for first, last in authors)
    return {
        **lists,
        "title": head.get("title a") or head.get("title") or None,
        "doi": head.get("doi") or None,
        "authors": [n for n in names if n],
        "sections": [{"title": d.get("title") or "Section", "text": "\n\n".join(d["text"])} for d in divs],
        "references": [{"title": r.get("title a") or r.get("title m") or None, "authors": r["authors"], "date": r.get("date", ""), "doi": r.get("doi") or None, "journal": r.get("title j") or None} for r in refs],
    }


CROSSREF = "struct<title:array<string>,author:array<struct<given:string,family:string>>,issued:struct<`date-parts`:array<array<int>>>,`container-title`:array<string>,DOI:string,URL:string,`is-referenced-by-count`:int>"
OPENALEX = "struct<title:string,authorships:array<struct<author:struct<display_name:string>>>,doi:string,publication_year:int,publication_date:string,primary_location:struct<source:struct<display_name:string>>,cited_by_count:int,id:string,abstract_inverted_index:map<string,array<int>>>"
SEMANTIC = "struct<title:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string>,year:int,publicationDate:string,venue:string,abstract:string,citationCount:int,url:string>"
PUBMED = "struct<title:string,authors:array<struct<name:string>>,source:string,pubdate:string,articleids:array<struct<idtype:string,value:string>>,uid:string>"


def scholarly(rows: DataFrame, payload: str = "json", provider: str = "provider") -> DataFrame:
    """rows plus title, authors, doi, year, journal, abstract, citations and url from each provider's own form.

    crossref, openalex, semantic_scholar and pubmed hold JSON, arxiv an Atom entry.
    """
    p = F.col(provider)
    parsed = spread(rows).withColumns(
        {n: F.when(p == name, F.from_json(payload, kind)) for n, name, kind in (("_c", "crossref", CROSSREF), ("_o", "openalex", OPENALEX), ("_s", "semantic_scholar", SEMANTIC), ("_p", "pubmed", PUBMED))}
    )
    bare = F.regexp_replace(F.col(payload), r"<(/?)\w+:", "<$1")
    entry = F.when(p == "arxiv", F.regexp_replace(bare, r'\sxmlns(:\w+)?="[^"]*"', ""))
    atom = lambda tag: F.replace(_first(entry, f"//{tag}/text()"), F.lit("\n"), F.lit(" "))
    names = lambda c: F.filter(c, lambda n: F.coalesce(n, F.lit("")) != "")
    full = F.transform("_c.author", lambda a: F.trim(F.concat_ws(" ", a["given"], a["family"])))
    own = lambda c, o, s, m, a: F.when(p == "crossref", c).when(p == "openalex", o).when(p == "semantic_scholar", s).when(p == "pubmed", m).when(p == "arxiv", a)
    none = F.lit(None).cast("string")
    doi = own(F.col("_c.DOI"), F.replace("_o.doi", F.lit("https://doi.org/")), F.col("_s.externalIds.DOI"), F.get(F.filter("_p.articleids", lambda x: x["idtype"] == "doi"), F.lit(0))["value"], atom("doi"))
    title = own(F.array_join("_c.title", " "), F.col("_o.title"), F.col("_s.title"), F.regexp_replace("_p.title", r"\.+$", ""), atom("title"))
    link = F.concat(F.lit("https://doi.org/"), doi)
    return parsed.select(
        *rows.columns,
        F.coalesce(T.non_empty(title), F.when(p == "arxiv", "Untitled Preprint").otherwise("Untitled Publication")).alias("title"),
        own(names(full), names(F.col("_o.authorships.author.display_name")), names(F.col("_s.authors.name")), names(F.col("_p.authors.name")), _texts(entry, "//author/name/text()")).alias("authors"),
        doi.alias("doi"),
        own(F.get(F.get("_c.issued.date-parts", F.lit(0)), F.lit(0)), F.col("_o.publication_year"), F.col("_s.year"), R.year_of(F.col("_p.pubdate")), R.year_of(atom("published"))).alias("year"),
        own(F.get("_c.container-title", F.lit(0)), F.col("_o.primary_location.source.display_name"), F.col("_s.venue"), F.col("_p.source"), F.lit("arXiv preprint")).alias("journal"),
        own(none, R.inverted_abstract(F.col("_o.abstract_inverted_index")), F.col("_s.abstract"), none, atom("summary")).alias("abstract"),
        own(F.col("_c.is-referenced-by-count"), F.col("_o.cited_by_count"), F.col("_s.citationCount"), F.lit(None).cast("int"), F.lit(None).cast("int")).alias("citations"),
        own(F.coalesce("_c.URL", link), F.coalesce("_o.doi", "_o.id"), F.coalesce("_s.url", link), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.col("_p.uid"), F.lit("/")), atom("id")).alias("url"),
    )


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of files, for layout parsers that users plug in with mapInArrow."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
