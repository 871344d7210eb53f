"""Column expressions: names of image files, CDN addresses, texts, prices, vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: image id of an entry that failed to load.
FAILED_IMAGE = 9_999_999_999


def empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def missing(c: Column) -> Column:
    """True for NULL and empty strings, which count as no value."""
    return F.coalesce(c == "", F.lit(True))


def flag(c: Column) -> Column:
    """A truth value as 1 or 0; NULL is 0."""
    return F.coalesce(c.cast("boolean").cast("int"), F.lit(0))


def parse_image_name(name: Column) -> Column:
    """struct(listing_id, image_id, ext) of ``{listing}_{image}.jpg`` or ``.dl``; NULL for other names."""
    form = r"^(\d+)_(\d+)\.(jpg|dl)$"
    part = lambda k: F.regexp_extract(name, form, k)
    whole = F.struct(part(1).try_cast("bigint").alias("listing_id"), part(2).try_cast("bigint").alias("image_id"), part(3).alias("ext"))
    return F.when(whole["listing_id"].isNotNull() & whole["image_id"].isNotNull(), whole)


def file_partition(name: Column, n: int = 8) -> Column:
    """All digits of the name, padded left to five; the first five, as a number, modulo n."""
    digits = F.regexp_replace(name, r"\D", "")
    return (F.substring(F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits), 1, 5).cast("int") % n).cast("int")


def parse_cdn_url(url: Column, suffix_class: str = "[a-z0-9]") -> Column:
    """struct(hex, suffix) of an image address; NULL if it has another form."""
    form = rf"/il/([a-f0-9]+)/(\d+)/il_[^.]+\.\d+_({suffix_class}+)\.jpg"
    found = F.struct(empty_to_null(F.regexp_extract(url, form, 1)).alias("hex"), empty_to_null(F.regexp_extract(url, form, 3)).alias("suffix"))
    return F.when(found["hex"].isNotNull(), found)


def build_cdn_url(host: str, shop: Column, hex_: Column, image: Column, suffix: Column, size: str = "570xN") -> Column:
    """Address from its parts; NULL if a part is missing or the image failed to load."""
    there = shop.isNotNull() & ~missing(hex_) & image.isNotNull() & (image != FAILED_IMAGE) & ~missing(suffix)
    return F.when(there, F.concat(F.lit(f"https://{host}/"), shop.cast("string"), F.lit("/r/il/"), hex_, F.lit("/"), image.cast("string"), F.lit(f"/il_{size}."), image.cast("string"), F.lit("_"), suffix, F.lit(".jpg")))


def listing_text(title: Column, materials: Column) -> Column:
    """Title and materials (a JSON list of strings) joined by ``". "``; other JSON gives the title alone."""
    listed = F.from_json(materials, "array<string>")
    strings = F.schema_of_variant(F.try_parse_json(materials)).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(listed, lambda x: x.isNull()), F.lit(False))
    joined = F.when(strings & (F.size(listed) > 0), F.array_join(listed, ", "))
    return F.concat_ws(". ", empty_to_null(title), joined)


def listing_price(amount: Column, divisor: Column) -> Column:
    """amount / divisor with defaults 0 and 100; a zero divisor counts as missing."""
    return F.coalesce(amount, F.lit(0)).cast("double") / F.coalesce(F.nullif(divisor, F.lit(0)), F.lit(100)).cast("double")


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def normalize(vector: Column) -> Column:
    """The vector over its length, as doubles; a zero vector stays as it is."""
    norm = F.sqrt(squared_norm(vector))
    return F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def tar_size(size: Column) -> Column:
    """Bytes of an archive member: a header block and the content, rounded up to 512."""
    return F.lit(512) + F.ceil(size / 512) * 512
