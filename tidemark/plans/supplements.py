"""Biographies planted in the documents, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.bios import biographies, firm_documents
from .fixtures import Tables, query

GIVEN = ["Anna", "Bruno", "Clara", "David", "Élise", "Frank", "Greta"]
MIDDLE = ["", "M. ", "Maria ", "van "]
FAMILY = ["Abel", "Brandt", "Conti", "Dahl-Roy", "Ebner", "O’Neil", "Fuchs", "Gruber", "Huber", "Iversen", "Jansen"]
#: How a document tells whose its section is, by its number modulo these; a name, and something that isn't it.
TOLD = [
    "Item 1 Cover Page\n{n}, CFA\nAcme Planning LLC\n12 Main Street",
    "Supervised Person's Name: {n}\nSome City 12345",
    "{n}'s Biographical Information",
    "Acme Planning LLC\nThis brochure supplement provides information about {n} that supplements the Acme brochure.",
    "Item 1 Cover Page\n{n} Acme\nThis supplement has information about {n} that supplements the Planning brochure.",
]
HEADING = ["Item 2 Educational Background and Business Experience", "ITEM 2 – EDUCATION AND BUSINESS EXPERIENCE", "Educational Background & Business Experience", "Item 2\nEducational Background and Business Experience"]
BIO = "Born in {y}. Studied at a college; a planner since then, case {d}."


def planted(t: Tables) -> DataFrame:
    """Each document with a supplement in its middle; in every fifth the same section stands twice, every seventh's is only named in a table of contents."""
    d = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("name", F.concat(_one(GIVEN, "doc_id % 7"), F.lit(" "), _one(MIDDLE, "floor(doc_id / 7) % 4"), _one(FAMILY, "floor(doc_id / 28) % 11")))
    d = d.withColumns({"told": F.replace(_one(TOLD, "doc_id % 5"), F.lit("{n}"), F.col("name")), "head": _one(HEADING, "floor(doc_id / 5) % 4")})
    number = F.when(F.expr("doc_id % 3 = 0"), F.concat(F.lit("\nCRD# "), F.expr("100000 + doc_id").cast("string"))).when(F.expr("doc_id % 3 = 1"), F.concat(F.lit("\nSearch by the firm's CRD# "), F.expr("500000 + doc_id").cast("string"))).otherwise("")
    bio = F.replace(F.replace(F.lit(BIO), F.lit("{y}"), F.expr("1930 + doc_id % 70").cast("string")), F.lit("{d}"), F.col("doc_id").cast("string"))
    end = F.lit("\nItem 3 Disciplinary Information\nNone.\n")
    section = F.concat(F.lit("\n"), F.col("told"), number, F.lit("\n"), F.col("head"), F.lit("\n"), bio, end)
    contents = F.concat(F.lit("\n"), F.col("name"), F.lit("\nItem 2 Educational Background and Business Experience ........ 3\nItem 3 Disciplinary Information 4\n"))
    middle = F.when(F.expr("doc_id % 7 = 3"), contents).when(F.expr("doc_id % 5 = 2 and doc_id % 2 = 0"), F.concat(section, section)).otherwise(section)
    return d.select("doc_id", F.concat("text", middle, F.col("text")).alias("text"))


def _one(items: list[str], by: str):
    return F.element_at(F.array(*map(F.lit, items)), F.expr(f"cast({by} as int) + 1"))


def _list(items: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


FOUND = f"""b as (select doc_id, {_list(GIVEN)}[doc_id % 7 + 1] || ' ' || {_list(MIDDLE)}[doc_id // 7 % 4 + 1] || {_list(FAMILY)}[doc_id // 28 % 11 + 1] as name, case when doc_id % 3 = 0 then 100000 + doc_id end as crd,
    'Born in ' || (1930 + doc_id % 70) || '. Studied at a college; a planner since then, case ' || doc_id || '.' as bio from documents where doc_id % 7 <> 3 and not (doc_id % 5 = 2 and doc_id % 2 = 0))"""


@query("x02_biographies", f"with {FOUND} select doc_id, name, crd, bio from b")
def x02(t: Tables) -> DataFrame:
    """The biography that stands in a whole document, whose it is by five kinds of witness, its number but not the firm's; entries of contents and doubled texts have none."""
    return biographies(planted(t), "doc_id", "text")


@query("m03_biographies", f"""with {FOUND}, d as (select 100000 + doc_id as crd, min(struct_pack(t := toxic, q := quality)) as d from labels group by 1)
    select doc_id % 150 as firm, count(*) as n, string_agg(name || '|' || coalesce(b.crd::varchar, '') || '|' || bio || '|' || coalesce((d.d.t = 1)::varchar || ' ' || (d.d.t + d.d.q)::varchar, ''), ';' order by name, b.crd nulls first, bio) as advisors from b left join d on d.crd = b.crd group by 1""")
def m03(t: Tables) -> DataFrame:
    """Each firm's biographies, ordered by name, with what is disclosed of those whose number is known."""
    flags = t.raw("labels").select((F.col("doc_id") + 100000).alias("crd"), (F.col("toxic") == 1).alias("regulatory"), (F.col("toxic") + F.col("quality")).alias("flag_count"))
    bios = biographies(planted(t), "doc_id", "text").select((F.col("doc_id") % 150).alias("firm"), "name", "crd", "bio")
    told = lambda a: F.concat(a["name"], F.lit("|"), F.coalesce(a["crd"].cast("string"), F.lit("")), F.lit("|"), a["bio"], F.lit("|"), F.coalesce(F.concat_ws(" ", a["disclosures"]["regulatory"].cast("string"), a["disclosures"]["flag_count"].cast("string")), F.lit("")))
    return firm_documents(bios, flags, "firm").select("firm", F.size("advisors").cast("long").alias("n"), F.array_join(F.transform("advisors", told), ";").alias("advisors"))
