"""Raw provider responses as records. Responses are kept as they came; every reading of them can be done again later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.registry import ndl_volume
from ..functions.scalars import normalize_isbn, tag_text

RAKUTEN = "Items array<struct<Item:struct<title:string,author:string,publisherName:string,salesDate:string,isbn:string,largeImageUrl:string,mediumImageUrl:string,smallImageUrl:string,itemUrl:string>>>, error string, error_description string"
GOOGLE = "items array<struct<volumeInfo:struct<title:string,authors:array<string>,publisher:string,publishedDate:string,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:struct<thumbnail:string,small:string,medium:string,large:string>,infoLink:string>>>, error struct<code:int,message:string>"
OPENBD = "array<struct<summary:struct<isbn:string,title:string,author:string,publisher:string,pubdate:string,cover:string,volume:string>>>"


def ndl_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """The items of an OpenSearch RSS: title, volume, creator, publisher, date, isbn (13 before 10), link."""
    keep = [c for c in responses.columns if c != body]
    d = responses.select(*keep, F.posexplode(F.regexp_extract_all(body, F.lit(r"(?s)<item>(.*?)</item>"), F.lit(1))).alias("ordinal", "x"))
    x = F.col("x")
    id_ = lambda kind: F.nullif(F.regexp_extract(x, f'<dc:identifier xsi:type="dcndl:{kind}">([^<]+)<', 1), F.lit(""))
    d = d.withColumn("title", F.coalesce(tag_text(x, "dc:title"), tag_text(x, "title"), F.lit(""))).withColumn("volume_raw", tag_text(x, "dcndl:volume"))
    isbn = normalize_isbn(F.coalesce(id_("ISBN13"), id_("ISBN")))
    return d.select(
        *keep, "ordinal", F.lit("ndl").alias("provider"), "title", "volume_raw", ndl_volume("volume_raw", F.lit("")).alias("volume"),
        tag_text(x, "dc:creator").alias("author"), tag_text(x, "dc:publisher").alias("publisher"), F.coalesce(tag_text(x, "dcterms:issued"), tag_text(x, "dc:date")).alias("date"),
        isbn.alias("isbn"), F.when(isbn.isNotNull(), F.concat(F.lit("https://ndlsearch.ndl.go.jp/thumbnail/"), isbn, F.lit(".jpg"))).alias("image_url"), tag_text(x, "link").alias("link"),
    )


def ndl_readings(responses: DataFrame, body: str = "body") -> DataFrame:
    """title, reading: the first reading that raw responses give for a title."""
    pair = r"(?s)<dc:title>(.*?)</dc:title>.{0,400}?<dcndl:titleTranscription>([^<]*)<"
    one = F.arrays_zip(F.regexp_extract_all(body, F.lit(pair), F.lit(1)).alias("t"), F.regexp_extract_all(body, F.lit(pair), F.lit(2)).alias("y"))
    d = responses.select(F.monotonically_increasing_id().alias("n"), F.posexplode(one).alias("k", "x"))
    d = d.select("n", "k", F.trim(F.regexp_replace("x.t", "<[^>]+>", "")).alias("title"), F.trim("x.y").alias("reading")).where("title <> '' and reading <> ''")
    return d.groupBy("title").agg(F.min_by("reading", F.struct("n", "k")).alias("reading"))


def rakuten_image(url: Column, size: int) -> Column:
    """The image at another size."""
    return F.regexp_replace(url, r"_ex=[0-9]+x[0-9]+", f"_ex={size}x{size}")


def rakuten_records(responses: DataFrame, body: str = "body", size: int = 600) -> DataFrame:
    keep = [c for c in responses.columns if c != body]
    d = responses.select(*keep, F.from_json(body, RAKUTEN).alias("j")).select(*keep, F.posexplode("j.Items").alias("ordinal", "x")).select(*keep, "ordinal", "x.Item.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    image = F.coalesce(blank("largeImageUrl"), blank("mediumImageUrl"), blank("smallImageUrl"))
    return d.select(
        *keep, "ordinal", F.lit("rakuten").alias("provider"), "title", F.col("author"), F.col("publisherName").alias("publisher"), F.col("salesDate").alias("date"),
        normalize_isbn(F.col("isbn")).alias("isbn"), rakuten_image(image, size).alias("image_url"), F.col("itemUrl").alias("link"),
    )


def google_image(url: Column) -> Column:
    """Over https, without the page curl."""
    return F.regexp_replace(F.regexp_replace(url, "^http:", "https:"), "&edge=curl", "")


def google_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """ISBN 13 before 10, authors joined; ``large`` tells that a large image exists."""
    keep = [c for c in responses.columns if c != body]
    d = responses.select(*keep, F.from_json(body, GOOGLE).alias("j")).select(*keep, F.posexplode("j.items").alias("ordinal", "x")).select(*keep, "ordinal", "x.volumeInfo.*")
    id_ = lambda kind: F.get(F.filter("industryIdentifiers", lambda i: i["type"] == kind), F.lit(0))["identifier"]
    large = F.coalesce(F.col("imageLinks.large"), F.col("imageLinks.medium"), F.col("imageLinks.small"))
    return d.select(
        *keep, "ordinal", F.lit("google").alias("provider"), "title", F.nullif(F.array_join("authors", "・"), F.lit("")).alias("author"), "publisher", F.col("publishedDate").alias("date"),
        normalize_isbn(F.coalesce(id_("ISBN_13"), id_("ISBN_10"))).alias("isbn"), google_image(F.coalesce(large, F.col("imageLinks.thumbnail"))).alias("image_url"),
        F.col("infoLink").alias("link"), large.isNotNull().alias("large"),
    )


def openbd_records(responses: DataFrame, body: str = "body") -> DataFrame:
    """Unknown ISBNs are null holes and give no row; an empty cover is none."""
    keep = [c for c in responses.columns if c != body]
    d = responses.select(*keep, F.posexplode(F.from_json(body, OPENBD)).alias("ordinal", "x")).where("x.summary is not null").select(*keep, "ordinal", "x.summary.*")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return d.select(*keep, "ordinal", F.lit("openbd").alias("provider"), "title", "author", "publisher", F.col("pubdate").alias("date"), normalize_isbn(F.col("isbn")).alias("isbn"), blank("cover").alias("image_url"))


def provider_errors(responses: DataFrame, body: str = "body") -> DataFrame:
    """Errors the responses carry, sorted into quota, auth and other; quota is looked for first."""
    text = F.lower(body)
    d = responses.where(F.col("status") >= 400)
    kind = F.when(text.rlike("quota|rate.?limit|too many"), "quota").when(text.rlike("api key|applicationid|unauthori[sz]ed|forbidden|ip address|credential"), "auth").otherwise("other")
    return d.withColumn("error_kind", kind).withColumn("stop", F.col("error_kind") != "other")


def best_variant(records: DataFrame, key: str, variant: str) -> DataFrame:
    """The records of each key's best author variant: the one with most records that have ISBN and volume, then the earliest."""
    score = records.groupBy(key, variant).agg(F.count_if(F.col("isbn").isNotNull() & F.col("volume").isNotNull()).alias("n"))
    best = score.groupBy(key).agg(F.max_by(variant, F.struct("n", F.negative(variant))).alias(variant))
    return records.join(best, [key, variant], "left_semi")
