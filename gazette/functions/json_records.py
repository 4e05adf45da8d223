"""Records of notices from JSON documents whose layout isn't known, as DataFrame operations.

A document is opened level by level, as columns: what the objects and arrays of one level hold is the next, in the document's order.
Arrays of objects are candidates. A field's key is the first of its names that a record has, else its first key of a fitting end; the
array with the most titles, records and common keys wins, and its records become rows. All of it is higher-order functions over
one row, so that a corpus of documents takes one pass without a shuffle or Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import urls as U

#: The names of each field in order of preference, as key_name() gives them.
TITLE_NAMES = ("title", "subject", "joboffertitle", "positiontitle", "postingtitle", "announcementtitle", "recruitmenttitle", "vacancytitle", "name", "headline", "rtnm", "제목", "공지명", "게시물명", "pbancnm")
AUTHOR_NAMES = ("author", "writer", "department", "dept", "organization", "기관", "작성자", "부서", "담당부서", "companyname", "sdnm")
PUBLISHED_NAMES = ("publishedat", "publisheddate", "createddate", "createdat", "regdate", "registeredat", "registrationdate", "date", "게시일", "등록일", "작성일")
START_NAMES = ("startdate", "startdatetime", "applicationstartdate", "applystartdate", "접수시작일", "신청시작일", "rtacptstrtdttm")
END_NAMES = ("enddate", "enddatetime", "deadline", "applicationenddate", "applyenddate", "접수마감일", "신청마감일", "rtacptenddttm")
URL_NAMES = ("detailurl", "url", "href", "link", "viewurl", "상세url")
ID_NAMES = ("realid", "jobofferid", "requisitionid", "externalid", "noticeid", "postid", "articleid", "seq", "id", "번호", "rtseq")
NAMES = {
    "title": TITLE_NAMES, "author": AUTHOR_NAMES, "published_at": PUBLISHED_NAMES, "application_start_at": START_NAMES, "application_end_at": END_NAMES,
    "detail_url": URL_NAMES, "external_id": ID_NAMES,
}
#: The ends of other names that stand for a field.
ENDS = {
    "title": ("title", "subject", "headline"),
    "published_at": ("date", "datetime", "timestamp", "publishedat", "createdat", "updatedat", "postedat"),
    "application_start_at": ("startdate", "startdatetime", "begindate"),
    "application_end_at": ("enddate", "enddatetime", "deadline", "duedate"),
    "detail_url": ("url", "href", "link"),
    "external_id": ("id", "seq", "no"),
}
#: Marks in the name of a date that begins or ends something, and in the name of what holds pictures.
START_MARKS = ("start", "begin", "from", "시작", "개시", "접수시작", "신청시작")
END_MARKS = ("end", "deadline", "due", "close", "마감", "종료", "접수마감", "신청마감")
MEDIA_MARKS = ("media", "image", "thumbnail", "thumb", "icon", "logo", "cover", "photo", "picture", "avatar")
PICTURE = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|bmp|ico)(?:\?|$)"
JSONP = r"^\s*[A-Za-z_$][\w.$]*\s*\(\s*((?s:.*))\s*\)\s*;?\s*$"
#: Elements of an array that are looked at, levels that are opened, and levels below a record that are searched for its link.
SAMPLE, LEVELS, LINK_LEVELS = 20, 8, 3


def payload(body: Column) -> Column:
    """The JSON text of a body, also from within a callback; null if it is neither."""
    inner = F.regexp_extract(body, JSONP, 1)
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(whole(F.trim(body)), whole(F.nullif(inner, F.lit(""))))


def key_name(key: Column) -> Column:
    """A key without case, spaces and signs."""
    return F.regexp_replace(F.lower(key), "[^0-9a-z가-힣]+", "")


def holds(name: Column, marks: tuple[str, ...]) -> Column:
    return name.rlike("|".join(marks))


def date_role(key: Column) -> Column:
    """What a date of this key tells: the start or the end of an application, or the publication."""
    name = key_name(key)
    return F.when(holds(name, START_MARKS), "application_start_at").when(holds(name, END_MARKS), "application_end_at").otherwise("published_at")


def kind(value: Column) -> Column:
    """records for an array of objects, array, object, string, null or value."""

    array = F.when(F.schema_of_variant(value).startswith("ARRAY<OBJECT<"), "records").otherwise("array")

    def of(sign: Column) -> Column:
        return F.when(sign == '"', "string").when(sign == "{", "object").when(sign == "[", array).when(sign.isNull() | (sign == "n"), "null").otherwise("value")

    return U.let(F.substring(F.to_json(value), 1, 1), of)


def texts_of(json: Column) -> Column:
    """An object's values by key, in its order: a string's is unquoted, other values' is their JSON."""
    return F.from_json(json, "map<string,string>")


def members(json: Column) -> Column:
    """An object's (key, text, kind) in its order."""
    return F.zip_with(F.map_entries(texts_of(json)), F.map_values(F.from_json(json, "map<string,variant>")), lambda e, v: F.struct(e["key"].alias("key"), e["value"].alias("text"), kind(v).alias("kind")))


def elements(json: Column) -> Column:
    """The first SAMPLE (key, text, kind) of an array, with null keys."""
    first = lambda k: F.slice(F.from_json(json, f"array<{k}>"), 1, SAMPLE)
    return F.zip_with(first("string"), first("variant"), lambda x, v: F.struct(F.lit(None).cast("string").alias("key"), x.alias("text"), kind(v).alias("kind")))


NODES = "array<struct<place:array<int>,path:string,key:string,text:string,kind:string>>"


def inside(node: Column) -> Column:
    """The nodes that an object or array holds."""
    held = F.when(node["kind"] == "object", members(node["text"])).when(node["kind"].isin("array", "records"), elements(node["text"]))

    def below(m: Column, i: Column) -> Column:
        step = F.when(m["key"].isNotNull(), F.concat(F.lit("."), m["key"])).otherwise(F.concat(F.lit("["), i.cast("string"), F.lit("]")))
        return F.struct(F.concat(node["place"], F.array(i)).alias("place"), F.concat(node["path"], step).alias("path"), m["key"].alias("key"), m["text"].alias("text"), m["kind"].alias("kind"))

    return F.coalesce(F.transform(held, below), F.array().cast(NODES))


def levels(root: Column, n: int, taken, within=inside) -> Column:
    """Those of the nodes below root, root first, that taken lets through, by levels. within(node) gives a node's own."""
    start = F.struct(F.array().cast(NODES).alias("found"), F.array(root).cast(NODES).alias("level"))
    step = lambda a, _: F.struct(F.concat(a["found"], F.filter(a["level"], taken)).alias("found"), F.flatten(F.transform(a["level"], within)).cast(NODES).alias("level"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(n)), start, step, lambda a: a["found"])


def node(text: Column, kind_: Column) -> Column:
    return F.struct(F.array().cast("array<int>").alias("place"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), text.alias("text"), kind_.alias("kind"))


def record_arrays(body: Column) -> Column:
    """The nodes of the arrays of objects that an object of the document holds, down to LEVELS levels."""
    own = lambda n: (n["kind"] == "records") & n["key"].isNotNull()
    return U.let(payload(body), lambda text: levels(node(text, kind(F.try_parse_json(text))), LEVELS, own))


def named(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), key_name(k).alias("name")))


def chosen(all_: Column, field: str) -> Column:
    """field_key() among named() keys."""
    names = F.array(*[F.lit(n) for n in NAMES[field]])
    placed = lambda x, i: F.struct(F.nullif(F.array_position(names, x["name"]), F.lit(0)).alias("at"), (-i).alias("last"), x["key"].alias("key"))
    by_name = F.array_min(F.filter(F.transform(all_, placed), lambda x: x["at"].isNotNull()))["key"]
    if field not in ENDS:
        return by_name
    fits = lambda x: x["name"].rlike(f"({'|'.join(ENDS[field])})$") & (date_role(x["key"]) == "published_at" if field == "published_at" else F.lit(True))
    return F.coalesce(by_name, F.get(F.filter(all_, fits), 0)["key"])


def field_key(keys: Column, field: str) -> Column:
    """The key for a field among a record's keys: by the first of its names that there is (the last key of that name), else the first of a fitting end."""
    return U.let(named(keys), lambda all_: chosen(all_, field))


def link_path(record: Column) -> Column:
    """The keys that lead to a record's link, from the record down; null if there is none.

    The record's own key, unless it is about pictures; else that of the first object, down to LINK_LEVELS levels and not below keys
    about pictures, whose value is a text and no picture's address.
    """
    of_key = lambda held, k: F.when(~holds(key_name(k), MEDIA_MARKS) & ~F.coalesce(F.try_element_at(held, k).rlike(PICTURE), F.lit(False)), F.array(k))
    own = U.let(texts_of(record), lambda held: U.let(field_key(F.map_keys(held), "detail_url"), lambda k: of_key(held, k)))
    # an object's path here is the keys above it, each behind a sign that ends keys
    objects = lambda n: F.transform(F.filter(inside(n), lambda m: (m["kind"] == "object") & ~holds(key_name(m["key"]), MEDIA_MARKS)), lambda m: F.struct(m["place"].alias("place"), F.concat(n["path"], m["key"], F.lit("\0")).alias("path"), m["key"].alias("key"), m["text"].alias("text"), m["kind"].alias("kind")))
    root = F.struct(F.array().cast("array<int>").alias("place"), F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), record.alias("text"), F.lit("object").alias("kind"))

    def linked(n: Column) -> Column:
        def with_key(all_: Column) -> Column:
            key = field_key(F.transform(all_, lambda m: m["key"]), "detail_url")
            fine = lambda m: (m["kind"] == "string") & (F.trim(m["text"]) != "") & ~m["text"].rlike(PICTURE)
            return U.let(key, lambda k: F.when(F.exists(all_, lambda m: (m["key"] == k) & fine(m)), k))

        return F.struct(n["place"].alias("place"), F.concat(n["path"], U.let(members(n["text"]), with_key)).alias("path"))

    found = F.filter(F.transform(levels(root, LINK_LEVELS, lambda n: F.lit(True), objects), linked), lambda x: x["path"].isNotNull())
    return F.coalesce(own, F.split(F.array_min(found)["path"], "\0"))


FIELDS = ("title", "author", "published_at", "application_start_at", "application_end_at", "external_id")


def scored(array: Column) -> Column:
    """(order, path, text, each field's key) of an array's node: least first is best. Null if its first record has no title's key.

    10 for each title in the sample, 1 for each record up to SAMPLE and 1 for each key that all of the sample have; the first of equals.
    """

    def judged(sample: Column) -> Column:
        all_have = F.aggregate(sample, F.map_keys(F.get(sample, 0)), lambda held, r: F.array_intersect(held, F.map_keys(r)))

        def with_title(title: Column) -> Column:
            titles = F.size(F.filter(sample, lambda r: F.trim(F.try_element_at(r, title)) != ""))
            score = 10 * titles + F.size(sample) + F.size(all_have)
            return F.when(title.isNotNull(), F.struct(F.struct((-score).alias("score"), array["place"].alias("place")).alias("order"), array["path"].alias("path"), array["text"].alias("text")))

        return U.let(field_key(F.map_keys(F.get(sample, 0)), "title"), with_title)

    return U.let(F.transform(F.slice(F.from_json(array["text"], "array<string>"), 1, SAMPLE), texts_of), judged)


def best_array(body: Column) -> Column:
    """(path, records, keys, link) of a document's array of notices: a key for each of FIELDS, and the keys to the link. Null if there is none."""

    def keys_of(first: Column) -> Column:
        return U.let(named(F.map_keys(texts_of(first))), lambda all_: F.struct(*[chosen(all_, f).alias(f) for f in FIELDS]))

    def opened(best: Column) -> Column:
        parts = lambda records: F.struct(best["path"].alias("path"), records.alias("records"), keys_of(F.get(records, 0)).alias("keys"), link_path(F.get(records, 0)).alias("link"))
        return F.when(best.isNotNull(), U.let(F.from_json(best["text"], "array<string>"), parts))

    return U.let(F.array_min(F.filter(F.transform(record_arrays(body), scored), lambda x: x.isNotNull())), opened)


def notices_of(docs: DataFrame, best: Column) -> DataFrame:
    """The notices of documents (doc_id, base) in best, an array of none or one best_array(): see extract().

    The arrays come out by an explode of their expression: a filter, also one that Spark adds for a column's explode, would be moved below
    and work them out once more.
    """

    def values(record: Column, i: Column) -> Column:
        def of(held: Column) -> Column:
            at = lambda field: F.try_element_at(held, F.col(f"best.keys.{field}"))
            first = F.try_element_at(held, F.get("best.link", F.lit(0)))
            below = F.aggregate(F.slice("best.link", 2, F.greatest(F.size("best.link") - 1, F.lit(0))), first, lambda json, key: F.try_element_at(texts_of(json), key))
            return F.struct(i.alias("record_index"), *[at(f).alias(f) for f in ("title", "author", "external_id", "published_at")], below.alias("link"))

        return U.let(texts_of(record), of)

    rows = docs.select("doc_id", "base", F.explode(best).alias("best"))
    rows = rows.select("doc_id", "base", F.col("best.path").alias("path"), F.explode(F.transform("best.records", values)).alias("x")).select("doc_id", "base", "path", "x.*")
    rows = rows.select(
        "doc_id", "record_index", T.squeezed("title").alias("title"), T.squeezed("author").alias("author"), U.canonical(U.absolute(F.col("base"), F.col("link"))).alias("detail_url"),
        F.nullif(T.squeezed("external_id"), F.lit("")).alias("external_id"), T.normal_dates("published_at").alias("published_at"),
        F.col("base").alias("url"), F.concat("path", F.lit("["), "record_index", F.lit("]")).alias("source_path"),
    )
    return rows.filter("title <> ''")


def extract(docs: DataFrame, doc_id: str = "doc_id", body: str = "body", base: str = "base") -> DataFrame:
    """(doc_id, record_index, title, author, detail_url, external_id, published_at, url, source_path) of the notices of JSON documents.

    Records without a title are left out; documents without an array of titled objects have no rows.
    """
    best = F.filter(F.array(best_array(F.col(body))), lambda x: x.isNotNull())
    return notices_of(docs.withColumns({"doc_id": F.col(doc_id), "base": F.coalesce(F.col(base), F.lit(""))}), best)


def extract_any(values: DataFrame) -> DataFrame:
    """As extract(), of documents that have several JSON values (doc_id, base, bodies): of the value with the most records.

    The first of equals counts, and none with a single record.
    """
    found = F.filter(F.transform("bodies", best_array), lambda x: F.size(x["records"]) > 1)
    best = U.let(found, lambda all_: U.let(F.array_max(F.transform(all_, lambda x: F.size(x["records"]))), lambda n: F.slice(F.filter(all_, lambda x: F.size(x["records"]) == n), 1, 1)))
    return notices_of(values, best)
