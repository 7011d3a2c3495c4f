"""Queries over users (customer), profiles (orders), organizations (nation) and upload records."""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import scalars as fn
from millrace.operators import relational as op
from millrace.plans.registry import Registry
from millrace.sources import images, multipart, uploads
from millrace.sources.keyed_table import KeyedTable
from millrace.sources.tables import json_rows, scan
from millrace.sources.versions import USERS
from millrace.sources.workspace import fresh_path

R = Registry()
#: Fixed instant that stands for "now", so that results can be compared.
AS_OF = "2026-01-01 00:00:00"


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return scan(spark, sf, "customer").withColumn("is_active", F.col("c_acctbal") >= 0)


def _profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as profiles; finished ones count as deleted."""
    gone = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return scan(spark, sf, "orders").withColumn("deleted_at", gone)


@R.add("SELECT * FROM customer")
def s4_table_scan(spark, sf):
    return scan(spark, sf, "customer")


@R.add("SELECT r_regionkey, r_name FROM region")
def s2_second_table(spark, sf):
    return scan(spark, sf, "region").select("r_regionkey", "r_name")


@R.add(
    """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS body FROM nation"""
)
def s9_json_rows(spark, sf):
    return json_rows(scan(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


#: Small images that are whole: a grey PNG of 3 x 2, a JPEG frame of 5 x 4, a GIF of 2 x 2, a BMP of 2 x 1 and a WebP of 7 x 6.
PNG = b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(bytes(8))) + _chunk(b"IEND", b"")
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x0b" + struct.pack(">BHHB", 8, 4, 5, 1) + b"\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x00?\x00" + b"\x12\xff\x00\x34\xff\xd9"
GIF = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x80, 0, 0) + bytes(6) + b"!\xfe\x02hi\x00" + b"," + struct.pack("<HHHHB", 0, 0, 2, 2, 0) + b"\x02\x02\x4c\x01\x00" + b";"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 62, 0, 54, 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0) + bytes(8)
WEBP = b"RIFF" + struct.pack("<I", 4 + 8 + 6) + b"WEBPVP8L" + struct.pack("<I", 5) + b"\x2f" + struct.pack("<I", 6 | 5 << 14) + b"\0"
IMAGES = (("png", PNG, 3, 2), ("jpeg", JPEG, 5, 4), ("gif", GIF, 2, 2), ("bmp", BMP, 2, 1), ("webp", WEBP, 7, 6))

#: The third of the uploads is a file of which only the first bytes are those of an image.
_CONTENT = (PNG, JPEG, PNG[:8])
_UPLOADS = f"""WITH up AS (SELECT n_nationkey % 20 AS k, n_nationkey AS seq,
  'img' || CAST(n_nationkey % 20 AS VARCHAR) || '.png' AS name,
  CASE n_nationkey % 3 WHEN 0 THEN unhex('{PNG.hex()}') WHEN 1 THEN unhex('{JPEG.hex()}') ELSE unhex('{PNG[:8].hex()}') END AS content
  FROM nation)
"""


def _uploads(spark, sf):
    n = F.col("n_nationkey")
    content = F.element_at(F.array(*[F.lit(c) for c in _CONTENT]), (n % 3 + 1).cast("int"))
    name = F.concat(F.lit("img"), (n % 20).cast("string"), F.lit(".png"))
    return scan(spark, sf, "nation").select(n.alias("seq"), name.alias("name"), content.alias("content"))


_IS_IMAGE = "seq % 3 <> 2"


@R.add(
    _UPLOADS
    + f"""SELECT name, CASE WHEN {_IS_IMAGE} THEN 'Image uploaded successfully' ELSE 'Image upload failed' END AS detail,
 CASE WHEN {_IS_IMAGE} THEN 'static/' || name ELSE '' END AS "imageUrl", CASE WHEN {_IS_IMAGE} THEN 200 ELSE 400 END AS status FROM up"""
)
def s7_upload_response(spark, sf):
    return uploads.response(_uploads(spark, sf))


@R.add(
    _UPLOADS
    + f"""SELECT name, CAST(octet_length(content) AS BIGINT) AS bytes FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY seq DESC) AS i
 FROM up WHERE {_IS_IMAGE}) WHERE i = 1"""
)
def s6_store_by_name(spark, sf):
    """Stores the images as files and scans the folder again (S5)."""
    folder = fresh_path(spark, "static")
    uploads.store(_uploads(spark, sf), folder, order="seq").write.format("noop").mode("overwrite").save()
    stored = uploads.scan_images(spark, folder, "*.png")
    return stored.select("name", F.octet_length("content").cast("long").alias("bytes"))


@R.add(_UPLOADS + f"SELECT name, seq FROM up WHERE NOT ({_IS_IMAGE})")
def c1_rejected_uploads(spark, sf):
    return uploads.split_uploads(_uploads(spark, sf))[1].select("name", "seq")


@R.add(_UPLOADS + "SELECT name, seq FROM up WHERE name LIKE '%1.png' AND " + _IS_IMAGE)
def p12_accept_filter(spark, sf):
    found = uploads.split_uploads(_uploads(spark, sf).where(F.col("name").endswith("1.png")))[0]
    return found.select("name", "seq")


_HARMED = f"p_partkey % {len(IMAGES)} AS kind, (p_partkey // {len(IMAGES)}) % 5 AS harm"


@R.add(
    f"""WITH k AS (SELECT p_partkey, {_HARMED} FROM part)
 SELECT p_partkey, CASE WHEN harm NOT IN (3, 4) THEN [{', '.join(repr(i[0]) for i in IMAGES)}][kind + 1] END AS format,
 CAST(CASE WHEN harm = 0 OR harm = 2 AND kind > 0 THEN [{', '.join(str(i[2]) for i in IMAGES)}][kind + 1] END AS INTEGER) AS width,
 CAST(CASE WHEN harm = 0 OR harm = 2 AND kind > 0 THEN [{', '.join(str(i[3]) for i in IMAGES)}][kind + 1] END AS INTEGER) AS height,
 CASE WHEN harm = 1 THEN 'the file ends early' WHEN harm = 2 AND kind = 0 THEN 'the checksum of IDAT is wrong'
 WHEN harm = 3 THEN 'the file is no image of a known format' WHEN harm = 4 THEN 'the name is not that of an image' END AS problem FROM k"""
)
def c1_decoded_images(spark, sf):
    """Files of five formats: whole, cut off by three bytes, with another byte in a PNG's data, with other first bytes, with another name."""
    n = F.col("p_partkey")
    kind, harm = (n % len(IMAGES)).cast("int"), F.floor(n / len(IMAGES)) % 5
    whole = F.element_at(F.array(*[F.lit(i[1]) for i in IMAGES]), kind + 1)
    byte = F.overlay(whole, F.unhex(F.lit("FE")), F.lit(PNG.index(b"IDAT") + 9), F.lit(1))
    content = F.when(harm == 1, F.substring(whole, F.lit(1), F.octet_length(whole) - 3)).when((harm == 2) & (kind == 0), byte)
    content = content.when(harm == 3, F.overlay(whole, F.unhex(F.lit("0000")), F.lit(1), F.lit(2))).otherwise(whole)
    names = F.concat(F.lit("p."), F.when(harm == 4, "txt").otherwise(F.element_at(F.array(*[F.lit(i[0]) for i in IMAGES]), kind + 1)))
    found = images.decoded(scan(spark, sf, "part").select("p_partkey", names.alias("name"), content.alias("content")), name="name")
    return found.select("p_partkey", "image.*")


@R.add(
    f"""WITH s AS (SELECT s_suppkey, s_suppkey % 5 AS k, s_name FROM supplier), p AS (
 SELECT s_suppkey, 0 AS part_no, 'title' AS field, NULL AS filename, CASE WHEN k = 1 THEN 2 * length(s_name) + 5 + length('b' || s_suppkey) ELSE length(s_name) END AS bytes, NULL AS problem FROM s WHERE k < 4
 UNION ALL SELECT s_suppkey, 1, 'image', 'i' || s_suppkey || '.png', CASE WHEN k = 3 THEN 0 ELSE {len(PNG)} END, CASE WHEN k = 2 THEN 'the final boundary is missing' END FROM s WHERE k < 4
 UNION ALL SELECT s_suppkey, NULL, NULL, NULL, NULL, 'no boundary in the content type' FROM s WHERE k = 4)
 SELECT s_suppkey, CAST(part_no AS INTEGER) AS part_no, field, filename, CAST(bytes AS INTEGER) AS bytes, problem FROM p"""
)
def s5_multipart_parts(spark, sf):
    """Requests of a text and an image: plain, with the boundary inside the text, cut off, with an empty file, and without a boundary."""
    found = multipart.form_parts(_requests(spark, sf))
    return found.select("s_suppkey", "part_no", "field", "filename", F.octet_length("content").alias("bytes"), "problem")


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    n, edge = F.col("s_suppkey"), F.concat(F.lit("--b"), F.col("s_suppkey").cast("string"))
    k, raw = n % 5, lambda c: c.cast("binary")
    title = F.when(k == 1, F.concat("s_name", F.lit("\r\n-"), edge, "s_name")).otherwise(F.col("s_name"))
    head = F.concat(edge, F.lit('\r\nContent-Disposition: form-data; name="title"\r\n\r\n'), title, F.lit("\r\n"), edge)
    name = F.concat(F.lit('\r\nContent-Disposition: form-data; name="image"; filename="C:\\\\tmp\\\\i'), n.cast("string"), F.lit('.png"\r\nContent-Type: image/png\r\n\r\n'))
    image = F.when(k == 3, raw(F.lit(""))).otherwise(F.lit(PNG))
    end = F.when(k == 2, "").otherwise(F.concat(F.lit("\r\n"), edge, F.lit("--\r\n")))
    kind = F.when(k == 4, "multipart/form-data").otherwise(F.concat(F.lit('multipart/form-data; boundary="b'), n.cast("string"), F.lit('"')))
    return scan(spark, sf, "supplier").select("s_suppkey", F.concat(raw(head), raw(name), image, raw(end)).alias("body"), kind.alias("content_type"))


@R.add(f"SELECT s_suppkey, 'i' || s_suppkey || '.png' AS name, 3 AS width, 2 AS height FROM supplier WHERE s_suppkey % 5 < 2")
def s5_uploaded_images(spark, sf):
    """From request bodies to the images in them that are whole."""
    found = uploads.checked(multipart.form_uploads(multipart.form_parts(_requests(spark, sf))))
    return found.where(F.col("image.problem").isNull()).select("s_suppkey", "name", "image.width", "image.height")


@R.add("SELECT * FROM (SELECT *, c_acctbal >= 0 AS is_active FROM customer) WHERE is_active")
def p1_active_users(spark, sf):
    return op.where_equal(_users(spark, sf), is_active=True)


@R.add("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey = 7")
def p2_profiles_of_user(spark, sf):
    return op.where_equal(scan(spark, sf, "orders"), o_custkey=7).select("o_orderkey", "o_custkey", "o_orderstatus")


@R.add("SELECT * FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)")
def p3_lookup(spark, sf):
    users = scan(spark, sf, "customer")
    key = users.agg(F.min("c_custkey")).first()[0]
    return spark.createDataFrame([op.lookup(users, c_custkey=key)], users.schema)


@R.add("SELECT c_name, c_nationkey, c_mktsegment FROM customer")
def p4_without_columns(spark, sf):
    return op.without(scan(spark, sf, "customer"), "c_custkey", "c_acctbal")


@R.add("SELECT c_name, c_acctbal FROM customer")
def p5_select_columns(spark, sf):
    return scan(spark, sf, "customer").select("c_name", "c_acctbal")


@R.add("SELECT vec_id FROM embeddings")
def p6_drop_columns(spark, sf):
    return op.without(scan(spark, sf, "embeddings"), "label", "embedding")


@R.add("SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def p7_add_column(spark, sf):
    return op.add_column(scan(spark, sf, "documents").select("doc_id", "n_chars"), scan(spark, sf, "labels"), "doc_id", "quality")


@R.add('SELECT vec_id, embedding[1]::DOUBLE AS "PCA0", embedding[2]::DOUBLE AS "PCA1", embedding[3]::DOUBLE AS "PCA2" FROM embeddings')
def p8_relabel(spark, sf):
    vectors = scan(spark, sf, "embeddings")
    return op.relabel(op.vector_slice(vectors, "embedding", [0, 1, 2], "v", "vec_id"), "PCA", keep=["vec_id"])


@R.add("SELECT embedding[1]::DOUBLE AS x0, embedding[2]::DOUBLE AS x1, label FROM embeddings")
def p9_matrix_slice(spark, sf):
    return op.vector_slice(scan(spark, sf, "embeddings"), "embedding", [0, 1], "x", "label")


_METHODS = "CASE event_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'PUT' ELSE 'HEAD' END"


@R.add(
    f"""SELECT event_id, {_METHODS} IN ('GET', 'HEAD', 'OPTIONS') OR user_id % 5 + 1 = 3 AS by_role,
 {_METHODS} IN ('GET', 'HEAD', 'OPTIONS') OR (user_id % 5 + 1 = 5 AND user_id % 7 = event_id % 7) AS by_owner FROM events"""
)
def p10_access(spark, sf):
    n = F.col("event_id") % 4
    method = F.when(n == 0, "GET").when(n == 1, "POST").when(n == 2, "PUT").otherwise("HEAD")
    role = F.col("user_id") % 5 + 1
    return scan(spark, sf, "events").select(
        "event_id",
        fn.may_access(method, role, 3).alias("by_role"),
        fn.may_access(method, role, 5, F.col("user_id") % 7, F.col("event_id") % 7).alias("by_owner"),
    )


@R.add('SELECT o_orderkey, o_orderstatus, c_name AS "user", c_name AS email FROM orders JOIN customer ON o_custkey = c_custkey')
def j1_profile_with_user(spark, sf):
    joined = op.profile_with_user(scan(spark, sf, "orders"), scan(spark, sf, "customer"), "o_custkey", "c_custkey", "c_name")
    return joined.select("o_orderkey", "o_orderstatus", "user", "email")


@R.add("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def j2_own_profile(spark, sf):
    return op.own_profile(scan(spark, sf, "customer"), scan(spark, sf, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name", "o_orderkey")


@R.add("SELECT o_orderkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j1_profile_organization(spark, sf):
    users = scan(spark, sf, "customer").join(scan(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return op.own_profile(users, scan(spark, sf, "orders"), "c_custkey", "o_custkey").select("o_orderkey", "n_name")


_URGENT = "o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'"


@R.add(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_URGENT})")
def u4_missing_profiles(spark, sf):
    profiles = scan(spark, sf, "orders").where(_URGENT)
    return op.missing_profiles(scan(spark, sf, "customer"), profiles, "c_custkey", "o_custkey").select("c_custkey")


@R.add(
    f"""SELECT o_orderkey, o_custkey, 'en' AS language, FALSE AS derived FROM orders WHERE {_URGENT}
 UNION ALL SELECT NULL, c_custkey, 'es', TRUE FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_URGENT})"""
)
def u4_derived_profiles(spark, sf):
    """Every user without a profile gets one of defaults."""
    profiles = scan(spark, sf, "orders").where(_URGENT).select("o_orderkey", "o_custkey", F.lit("en").alias("language"), F.lit(False).alias("derived"))
    return op.insert_missing(profiles, scan(spark, sf, "customer"), "o_custkey", "c_custkey", language="es", derived=True)


def _age_sql(since: str, as_of: str) -> str:
    """The library's rule in the words of SQL: whole seconds of the difference, less the leap days, in two units of a fixed list."""
    leap = lambda y: f"({y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0))"
    days = f"len(list_filter(range(year({since}), year({as_of})), lambda y: {leap('y')}))"
    days = f"CASE WHEN {days} = 0 THEN 0 WHEN {leap(f'year({since})')} THEN {days} - 1 WHEN {leap(f'year({as_of})')} THEN {days} + 1 ELSE {days} END"
    left = f"CAST(floor((epoch_us({as_of}) - epoch_us({since})) / 1000000.0) AS BIGINT) - 86400 * ({days})"
    units = "[{u: 'year', s: 31536000}, {u: 'month', s: 2592000}, {u: 'week', s: 604800}, {u: 'day', s: 86400}, {u: 'hour', s: 3600}, {u: 'minute', s: 60}, {u: 'none', s: 1}]"
    first = f"list_position(list_transform({units}, lambda x: s // x.s > 0), true)"
    told = lambda n, at: f"{n} || chr(160) || ({units})[{at}].u || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
    n, m = f"(s // ({units})[i].s)", f"((s % ({units})[i].s) // ({units})[i + 1].s)"
    second = f"CASE WHEN i < 6 AND {m} > 0 THEN ', ' || {told(m, 'i + 1')} ELSE '' END"
    return f"""SELECT event_id, CASE WHEN s < 60 THEN '0' || chr(160) || 'minutes' ELSE {told(n, 'i')} || {second} END AS age
 FROM (SELECT event_id, s, {first} AS i FROM (SELECT event_id, {left} AS s FROM ev))"""


@R.add(
    f"""WITH ev AS (SELECT event_id, ts - to_days(CAST(event_id % 5000 AS INTEGER)) - to_microseconds((event_id % 7) * 150000) AS ts FROM events) """
    + _age_sql("ts", f"TIMESTAMP {AS_OF!r}")
)
def f1_age_in_words(spark, sf):
    """Ages of up to about 15 years, over leap years and with fractions of seconds."""
    n = F.col("event_id")
    back = F.make_dt_interval((n % 5000).cast("int"), F.lit(0), F.lit(0), ((n % 7) * 0.15).cast("decimal(18,6)"))
    return scan(spark, sf, "events").select("event_id", fn.age_in_words(F.col("ts") - back, F.lit(AS_OF).cast("timestamp")).alias("age"))


@R.add(f"SELECT event_id, TIMESTAMP '{AS_OF}' AS updated_at FROM events")
def f2_touched(spark, sf):
    return op.touched(scan(spark, sf, "events").select("event_id"), F.lit(AS_OF).cast("timestamp"), "updated_at")


@R.add("SELECT c_custkey, c_name || ' ' || coalesce(nullif(c_mktsegment, 'BUILDING'), 'None') AS shown FROM customer")
def f3_display_name(spark, sf):
    last = F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))
    return scan(spark, sf, "customer").select("c_custkey", fn.display_name(F.col("c_name"), last).alias("shown"))


@R.add("SELECT p_partkey, 'static/' || p_name AS path, abs(p_retailprice - 1000) AS off, 'PC' || p_size AS label FROM part")
def f4_paths_and_labels(spark, sf):
    return scan(spark, sf, "part").select(
        "p_partkey",
        fn.static_path(F.col("p_name")).alias("path"),
        F.abs(F.col("p_retailprice") - 1000).alias("off"),
        fn.component_label(F.col("p_size")).alias("label"),
    )


@R.add(
    """SELECT c_custkey, CASE c_nationkey % 6 WHEN 1 THEN 'User' WHEN 2 THEN 'Guest' WHEN 3 THEN 'Admin' WHEN 4 THEN 'Manager'
 WHEN 5 THEN 'Superuser' END AS role FROM customer"""
)
def f7_enum_lookup(spark, sf):
    return scan(spark, sf, "customer").select("c_custkey", fn.enum_name(F.col("c_nationkey") % 6, fn.ROLES).alias("role"))


@R.add(
    """SELECT doc_id, CASE WHEN lang IN ('en', 'es') THEN 0 ELSE 1 END + CASE WHEN length(source) <= 4 THEN 0 ELSE 1 END AS n_errors,
 CASE WHEN lang IN ('en', 'es') THEN NULL ELSE 'The provided language is not valid.' END AS language_error FROM documents"""
)
def c3_validate(spark, sf):
    checks = op.profile_checks(F.col("lang"), {"source": (F.col("source"), 4)})
    checked = op.validate(scan(spark, sf, "documents"), checks)
    message = next(iter(checks))
    said = F.when(F.array_contains("errors", message), message).alias("language_error")
    return checked.select("doc_id", F.size("errors").alias("n_errors"), said)


@R.add("SELECT doc_id FROM documents WHERE lang IN ('en', 'es') AND length(source) <= 4")
def c1_valid_rows(spark, sf):
    checks = op.profile_checks(F.col("lang"), {"source": (F.col("source"), 4)})
    return op.split_valid(op.validate(scan(spark, sf, "documents"), checks))[0].select("doc_id")


@R.add("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def c2_duplicated_keys(spark, sf):
    return op.duplicated(scan(spark, sf, "orders"), "o_custkey").select("o_orderkey", "o_custkey")


_CODE = "(s_suppkey - CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END) * 40"


@R.add(
    f"""SELECT s_suppkey, code, count(*) OVER (PARTITION BY code) = 1 AND code NOT IN (SELECT c_custkey FROM customer) AS "unique"
 FROM (SELECT s_suppkey, CAST({_CODE} AS BIGINT) AS code FROM supplier)"""
)
def c2_unique_against_existing(spark, sf):
    new = scan(spark, sf, "supplier").select("s_suppkey", F.expr(_CODE).cast("long").alias("code"))
    return op.uniqueness(new, scan(spark, sf, "customer").withColumnRenamed("c_custkey", "code"), "code")


#: Addresses by the remainder of the key, and whether each has the form of an email address.
_EMAILS = (
    ("c_name", False), ("concat('u', c_custkey, '@example')", False), ("concat('u', c_custkey, '@example.org')", True),
    ("concat('u ', c_custkey, '@a.example.org')", False), ("concat('u', c_custkey, '@LocalHost')", True), ("concat('a..', c_custkey, '@x.yz')", False),
    ("concat('a.', c_custkey, '+x@sub.x-y.org')", True), ("concat('u', c_custkey, '@-x.org')", False), ("concat('u', c_custkey, '@[10.0.0.7]')", True),
    ("concat('u', c_custkey, '@[10.0.0.256]')", False), ("concat('\"q!', c_custkey, '\"@x.org')", True), ("concat('u', c_custkey, '@x.o')", False),
    ("concat('u', c_custkey, '@[::1]')", True), ("concat('u', c_custkey, '@a@x.org')", False),
)
_EMAIL = f"CASE c_custkey % {len(_EMAILS)} " + " ".join(f"WHEN {i} THEN {e}" for i, (e, _) in enumerate(_EMAILS)) + " END"


@R.add(f"SELECT c_custkey, c_custkey % {len(_EMAILS)} IN ({', '.join(str(i) for i, (_, ok) in enumerate(_EMAILS) if ok)}) AS valid FROM customer")
def c1_email_form(spark, sf):
    checked = op.validate(scan(spark, sf, "customer"), op.profile_checks(F.lit("es"), {}, F.expr(_EMAIL)))
    return checked.select("c_custkey", (F.size("errors") == 0).alias("valid"))


@R.add(
    """SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL
 SELECT CAST(n_nationkey + 100 AS INTEGER), upper(n_name), 9 FROM nation WHERE n_regionkey = 1"""
)
def u1_insert_rows(spark, sf):
    nation = scan(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    new = nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).cast("int").alias("n_nationkey"), F.upper("n_name").alias("n_name"))
    return op.append_rows(nation, new, n_regionkey=9)


@R.add(
    """SELECT c.c_custkey, CASE WHEN s.s_suppkey IS NULL THEN c.c_name ELSE s.s_name END AS c_name,
 CASE WHEN s.s_suppkey IS NULL THEN c.c_acctbal ELSE s.s_acctbal END AS c_acctbal
 FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey"""
)
def u2_update_by_key(spark, sf):
    changes = scan(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return op.update_by_key(scan(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), changes, "c_custkey")


_DELETED = "CASE WHEN o_orderstatus = 'F' THEN o_orderdate END"


@R.add(f"SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 3 THEN TIMESTAMP '{AS_OF}' ELSE {_DELETED} END AS deleted_at FROM orders")
def u3_soft_delete(spark, sf):
    gone = op.soft_delete(_profiles(spark, sf), F.col("o_orderkey") % 10 == 3, F.lit(AS_OF).cast("timestamp"))
    return gone.select("o_orderkey", "deleted_at")


@R.add("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def u3_alive(spark, sf):
    return op.alive(_profiles(spark, sf)).select("o_orderkey")


@R.add(
    f"""SELECT c_custkey, c_custkey % 10 <> 3 AND c_acctbal >= 0 AS is_active, CASE WHEN c_custkey % 10 = 3 THEN TIMESTAMP '{AS_OF}' END AS deleted_at
 FROM customer"""
)
def u3_deleted_users(spark, sf):
    users = _users(spark, sf).withColumn("deleted_at", F.lit(None).cast("timestamp"))
    gone = op.delete_users(users, F.col("c_custkey") % 10 == 3, F.lit(AS_OF).cast("timestamp"))
    return gone.select("c_custkey", "is_active", "deleted_at")


@R.add(
    f"""SELECT c_custkey, CASE WHEN c_custkey % 50 = 7 THEN upper(c_mktsegment) ELSE c_name END AS c_name, CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE c_acctbal END AS c_acctbal,
 CASE WHEN c_custkey % 50 = 9 THEN TIMESTAMP '{AS_OF}' END AS deleted_at FROM customer WHERE c_custkey % 50 <> 11
 UNION ALL SELECT s_suppkey + 10000000, s_name, s_acctbal, NULL FROM supplier"""
)
def u2_keyed_table(spark, sf):
    """A table on disk: rows updated, inserted, marked as deleted and deleted by key, bucket by bucket, and read back."""
    users = scan(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", F.lit(None).cast("timestamp").alias("deleted_at"))
    key = F.col("c_custkey")
    table = KeyedTable.create(users, fresh_path(spark, "users"), "c_custkey", buckets=16)
    table.update(scan(spark, sf, "customer").where(key % 50 == 7).select(key, F.upper("c_mktsegment").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal")))
    new = scan(spark, sf, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    table.upsert(new)
    table.mark(users.where(key % 50 == 9).select(key), deleted_at=F.lit(AS_OF).cast("timestamp"))
    table.delete(users.where(key % 50 == 11).select(key))
    return KeyedTable.open(spark, table.path).read()


@R.add(
    """WITH gone AS (SELECT c_custkey FROM customer WHERE c_custkey % 7 = 0), og AS (SELECT s_suppkey, s_suppkey % 40 AS owner FROM supplier),
 pr AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 25 END AS org FROM orders),
 ok AS (SELECT s_suppkey FROM og WHERE owner NOT IN (SELECT c_custkey FROM gone))
 SELECT 'user' AS "table", CAST(c_custkey AS BIGINT) AS id FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
 UNION ALL SELECT 'organization', s_suppkey FROM ok
 UNION ALL SELECT 'userprofile', o_orderkey FROM pr WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
  AND (org IS NULL OR org NOT IN (SELECT s_suppkey FROM og) OR org IN (SELECT s_suppkey FROM ok))"""
)
def j1_cascade_delete(spark, sf):
    """Users that go take their organizations and profiles along, and organizations take the profiles in them."""
    users, orgs, profiles = (scan(spark, sf, t) for t in ("customer", "supplier", "orders"))
    orgs = orgs.select("s_suppkey", (F.col("s_suppkey") % 40).alias("owner"))
    profiles = profiles.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 25).alias("org"))
    references = [("organization", "owner", "user", "c_custkey"), ("userprofile", "o_custkey", "user", "c_custkey"), ("userprofile", "org", "organization", "s_suppkey")]
    left = op.cascade_delete({"user": users, "organization": orgs, "userprofile": profiles}, references, {"user": users.where("c_custkey % 7 = 0")})
    ids = {"user": "c_custkey", "organization": "s_suppkey", "userprofile": "o_orderkey"}
    return op.union_all([left[t].select(F.lit(t).alias("table"), F.col(c).cast("long").alias("id")) for t, c in ids.items()])


@R.add("SELECT c_custkey, true AS is_active, true AS is_staff, true AS is_superuser FROM customer")
def u5_new_superusers(spark, sf):
    return op.new_users(scan(spark, sf, "customer").select("c_custkey"), superuser=True)


@R.add("SELECT c_custkey, true AS is_active, false AS is_staff, false AS is_superuser FROM customer")
def u5_new_users(spark, sf):
    return op.new_users(scan(spark, sf, "customer").select("c_custkey"))


@R.add(
    """SELECT c_custkey AS id, c_name, true AS is_active, CAST(NULL AS BIGINT) AS organization_id,
 coalesce(TRY_CAST(CASE WHEN c_custkey % 2 = 0 THEN '4' ELSE 'admin' END AS BIGINT), 1) AS role FROM customer"""
)
def e1_evolve_schema(spark, sf):
    role = F.when(F.col("c_custkey") % 2 == 0, "4").otherwise("admin")
    users = scan(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", role.alias("role"))
    return op.evolve(
        users,
        ("rename", "c_custkey", "id"),
        ("add", "is_active", "boolean", True),
        ("add", "organization_id", "long", None),
        ("alter", "role", "long", 1),
        ("drop", "c_mktsegment"),
    )


@R.add(
    """WITH c AS (SELECT *, c_custkey % 8 + 1 AS v, ['admin', '3', 'Guest'][c_nationkey % 3 + 1] AS told FROM customer)
 SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS email,
 CAST(CASE WHEN v IN (1, 2, 5) THEN CASE told WHEN '3' THEN 3 ELSE 1 END ELSE c_nationkey % 5 + 1 END AS BIGINT) AS role,
 CASE WHEN v < 4 THEN true ELSE c_acctbal >= 0 END AS is_active, v >= 4 AND c_nationkey = 3 AS is_staff, false AS is_superuser FROM c"""
)
def e1_versioned_schemas(spark, sf):
    """Users in files of all eight versions, each in its own form, read as one table of the newest."""
    key, told = F.col("c_custkey"), F.element_at(F.array(F.lit("admin"), F.lit("3"), F.lit("Guest")), (F.col("c_nationkey") % 3 + 1).cast("int"))
    number = (F.col("c_nationkey") % 5 + 1).cast("long")
    every = {
        "id": key.cast("long"), "password": F.lit("x"), "email": F.col("c_name"), "last_login": F.lit(AS_OF).cast("timestamp"), "role_id": number,
        "is_active": F.col("c_acctbal") >= 0, "is_staff": F.col("c_nationkey") == 3, "is_superuser": F.lit(False),
    }
    folder = fresh_path(spark, "versions")
    for v in range(1, USERS.newest + 1):
        role = told if v in (1, 2, 5) else number
        own = {**every, "role": role}
        rows = scan(spark, sf, "customer").where(key % 8 + 1 == v)
        USERS.write(rows.select(*[own[c].alias(c) for c in USERS.schema("user", v).names]), folder, "user", v)
    return USERS.read(spark, folder, "user").select("id", "email", "role", "is_active", "is_staff", "is_superuser")


@R.add("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def t1_first_rows(spark, sf):
    return op.first_rows(scan(spark, sf, "customer"), "c_custkey").select("c_custkey", "c_name")


@R.add("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def t2_sorted(spark, sf):
    return op.sorted_desc(scan(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@R.add("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def t3_top_ten(spark, sf):
    return op.top_k(scan(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey", 10)
