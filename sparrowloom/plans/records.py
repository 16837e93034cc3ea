"""Sources: payloads are written out of whole tables and parsed back; the SQL takes what they have to give from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts
from ..registry import query
from ..runtime import table
from ..sources import records, web
from .tables import C, G, K, M, rows

_COLUMNS = ["title", "url", "doc_type", "content", "metadata", "agent_id", "created_at"]


def _cms(s, d):
    return rows(s, d, "cms_documents", columns=_COLUMNS)


def _j(*pairs):
    return F.to_json(F.struct(*(v.alias(k) for k, v in pairs)))


c = F.col
_ATTR = lambda: F.struct(c("title").alias("title"), F.struct(c("content").alias("processed")).alias("body"))
_ITEM = lambda: F.struct(c("id").alias("id"), F.concat(F.lit("node--"), F.lower("doc_type")).alias("type"), _ATTR().alias("attributes"))

# JSON paths

for _name in ("json_path_dot", "json_field_get"):
    query(_name, f"SELECT id, json_extract_string(metadata, '$.tags[0]') AS first_tag, json_extract_string(metadata, '$.tags[1]') AS second_tag, CAST(json_extract_string(metadata, '$.rev') AS BIGINT) AS rev, json_extract_string(metadata, '$.a.b') AS none FROM {C}")(
        lambda s, d: _cms(s, d).select("id", records.field(c("metadata"), "tags[0]").alias("first_tag"), records.field(c("metadata"), "tags.1").alias("second_tag"), records.field(c("metadata"), "rev").cast("bigint").alias("rev"), records.field(c("metadata"), "a.b").alias("none"))
    )
query("json_path_dollar", f"SELECT id, CAST(i - 1 AS BIGINT) AS pos, json_extract_string(metadata, '$.tags[' || (i - 1) || ']') AS tag FROM (SELECT id, metadata, unnest(range(1, CAST(json_array_length(metadata, '$.tags') AS BIGINT) + 1)) AS i FROM {C} WHERE json_array_length(metadata, '$.tags') > 0)")(
    lambda s, d: _cms(s, d).where("metadata like '%\"tags\"%'").select("id", F.posexplode(records.dollar_items(c("metadata"), "$.tags[*].name"))).select("id", c("pos").cast("bigint").alias("pos"), c("col").alias("tag"))
)

# documents

_DOC = "coalesce(nullif(id, ''), 'doc-0')"


def _shown(docs):
    return docs.select("id", F.when(~c("content").startswith('{"'), c("content")).alias("content"), *(c("metadata")[k].alias(k) for k in ("title", "type")))


query("src_json", f"SELECT {_DOC} AS id, nullif(content, '') AS content, title, coalesce(nullif(lower(doc_type), ''), 'content') AS type FROM {C}")(
    lambda s, d: _shown(records.json_documents(_cms(s, d).select(_j(("items", F.array(F.struct(c("id").alias("key"), c("content").alias("body"), F.struct(c("title").alias("title"), F.lower("doc_type").alias("kind")).alias("meta"))))).alias("p")), "p", {"id": "key", "content": "body", "title": "meta.title", "type": "meta.kind"}, "items"))
)
query("src_json_ec", f"SELECT 'doc-0' AS id, nullif(content, '') AS content, title FROM {C}")(
    lambda s, d: records.json_documents(_cms(s, d).select(_j(("content", c("content")), ("title", c("title"))).alias("p")), "p", {"title": "title"}, default_type=None).select("id", F.when(~c("content").rlike(r'^\{(?:"|\})'), c("content")).alias("content"), c("metadata")["title"].alias("title"))
)
query("udf_field_const", f"SELECT count(*) AS n, 'shop' AS channel FROM {C}")(
    lambda s, d: records.json_documents(_cms(s, d).select(_j(("id", c("id"))).alias("p")), "p", constants={"channel": "shop"}).groupBy(c("metadata")["channel"].alias("channel")).agg(F.count("*").alias("n"))
)
query("src_drupal", f"SELECT id, nullif(content, '') AS content, title, lower(doc_type) AS type FROM {C} WHERE doc_type IS NOT NULL")(
    lambda s, d: _shown(records.json_documents(_cms(s, d).where("doc_type is not null").select(_j(("data", F.array(_ITEM()))).alias("p"), F.lower("doc_type").alias("t")), "p", {"id": "id", "content": "attributes.body.processed", "title": "attributes.title"}, "data", keep=["t"]).withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda k, v: k != "type"), F.create_map(F.lit("type"), "t"))))
)
for _name, _prefix in (("src_wordpress", "posts"), ("src_strapi", "articles")):
    query(_name, f"SELECT id, nullif(content, '') AS content, title, '{_prefix[:-1]}' AS type FROM {C}")(
        lambda s, d, p=_prefix: _shown(records.json_documents(_cms(s, d).select(F.concat(F.lit("["), _j(("id", c("id")), ("attributes", _ATTR())), F.lit("]")).alias("p")), "p", {"id": "id", "content": "attributes.body.processed", "title": "attributes.title"}, constants={"type": p[:-1]}))
    )
query("src_sanity", f"SELECT id, content AS content FROM {C} WHERE content <> ''")(
    lambda s, d: records.json_documents(_cms(s, d).where("content <> ''").select(_j(("result", F.struct(c("id").alias("_id"), c("content").alias("text")))).alias("p")), "p", {"id": "_id", "content": "text"}, "result").select("id", "content")
)
query("drupal_type", f"SELECT DISTINCT lower(doc_type) AS kind FROM {C} WHERE doc_type IS NOT NULL")(lambda s, d: _cms(s, d).where("doc_type is not null").select(F.regexp_replace(F.concat(F.lit("node--"), F.lower("doc_type")), "^node--", "").alias("kind")).distinct())
for _name in ("wp_type", "strapi_type"):
    query(_name, f"SELECT DISTINCT lower(doc_type) AS kind FROM {C} WHERE doc_type IS NOT NULL")(lambda s, d: _cms(s, d).where("doc_type is not null").select(texts.singular(F.concat(F.lower("doc_type"), F.lit("s"))).alias("kind")).distinct())
query("sanity_blocks_to_text", f"SELECT id, subject || chr(10) || chr(10) || coalesce(description, '') AS text FROM {K} WHERE subject IS NOT NULL")(
    lambda s, d: rows(s, d, "support_tickets", "subject is not null", ["subject", "description"]).select(
        "id", records.portable_text(F.array(F.struct(F.lit("block").alias("_type"), F.array(F.struct(F.substring("subject", 1, 3).alias("text")), F.struct(F.expr("substring(subject, 4)").alias("text"))).alias("children")), F.struct(F.lit("image").alias("_type"), F.array(F.struct(F.lit("x").alias("text"))).alias("children")), F.struct(F.lit("block").alias("_type"), F.array(F.struct(c("description").alias("text"))).alias("children")))).alias("text")
    )
)
query("src_url_fetch", f"SELECT id, url AS source_url, '2026-01-01T00:00:00.000Z' AS fetched_at, 'x' AS team FROM {C} WHERE url IS NOT NULL")(
    lambda s, d: records.with_origin(records.json_documents(_cms(s, d).where("url is not null").select("url", _j(("id", c("id")), ("content", c("content"))).alias("p")), "p", keep=["url"]), "url", F.lit("2026-01-01").cast("timestamp"), {"team": "x"}).select("id", c("metadata")["sourceUrl"].alias("source_url"), c("metadata")["fetchedAt"].alias("fetched_at"), c("metadata")["team"].alias("team"))
)
_AUTH = "CASE agent_no % 4 WHEN 0 THEN 'bearer' WHEN 1 THEN 'basic' WHEN 2 THEN 'api-key' ELSE 'custom' END"
for _name in ("src_auth_headers", "src_auth_headers_ec"):
    query(_name, f"SELECT agent_id, CASE k WHEN 'bearer' THEN 'Authorization: Bearer ' || agent_id WHEN 'basic' THEN 'Authorization: Basic ' || base64(encode(agent_id || ':' || model)) WHEN 'api-key' THEN 'X-API-Key: ' || agent_id END AS header FROM (SELECT *, {_AUTH} AS k FROM (SELECT *, CAST(regexp_extract(agent_id, '[0-9]+') AS INTEGER) AS agent_no FROM agents WHERE model IS NOT NULL))")(
        lambda s, d: table(s, d, "agents").where("model is not null").withColumn("agent_no", F.regexp_extract("agent_id", "[0-9]+", 0).cast("int")).select("agent_id", records.auth_headers(F.expr(_AUTH), c("agent_id"), c("agent_id"), c("model"), F.lit(None).cast("string"), c("agent_id")).alias("header"))
    )

# webhooks

_SHOP = "CAST(metadata['price'] AS DOUBLE)"


def _goods(s, d):
    return rows(s, d, "rag_documents", columns=["content", "metadata"]).where("metadata['item'] is not null")


def _variant(s, d):
    return _goods(s, d).select(_j(("handle", c("id")), ("title", c("metadata")["item"]), ("body_html", F.substring("content", 1, 200)), ("variants", F.array(F.struct(c("metadata")["price"].alias("price"), c("id").alias("sku"), F.length("content").alias("inventory_quantity"))))).alias("p"))


_ITEMS = f"(SELECT * FROM {G} WHERE metadata['item'] IS NOT NULL)"
query("map_shopify", f"SELECT id, metadata['item'] || chr(10) || coalesce(substring(content, 1, 200), '') AS content, id AS sku, metadata['price'] AS price, coalesce(length(content), 0) > 0 AS in_stock FROM {_ITEMS}")(
    lambda s, d: _variant(s, d).select(F.coalesce(F.nullif(records.field(c("p"), "id"), F.lit("")), records.field(c("p"), "handle")).alias("id"), F.concat(records.field(c("p"), "title"), F.lit("\n"), F.coalesce(records.field(c("p"), "body_html"), F.lit(""))).alias("content"), records.field(c("p"), "variants[0].sku").alias("sku"), records.field(c("p"), "variants[0].price").alias("price"), (F.coalesce(records.field(c("p"), "variants[0].inventory_quantity").cast("int"), F.lit(0)) > 0).alias("in_stock"))
)
query("map_woocommerce", f"SELECT id, metadata['item'] || chr(10) || coalesce(substring(content, 1, 200), '') AS content, concat_ws(',', metadata['color'], metadata['material']) AS categories, content IS NOT NULL AS in_stock FROM {_ITEMS}")(
    lambda s, d: _goods(s, d).select(_j(("sku", c("id")), ("name", c("metadata")["item"]), ("description", F.substring("content", 1, 200)), ("stock_status", F.when(c("content").isNotNull(), "instock").otherwise("outofstock")), ("categories", F.transform(F.array_compact(F.array(c("metadata")["color"], c("metadata")["material"])), lambda n: F.struct(n.alias("name"))))).alias("p"))
    .select(F.coalesce(F.nullif(records.field(c("p"), "id"), F.lit("")), records.field(c("p"), "sku")).alias("id"), F.concat(records.field(c("p"), "name"), F.lit("\n"), F.coalesce(records.field(c("p"), "description"), F.lit(""))).alias("content"), F.array_join(F.transform(F.from_json(records.field(c("p"), "categories"), "array<struct<name:string>>"), lambda x: x["name"]), ",").alias("categories"), (records.field(c("p"), "stock_status") == "instock").alias("in_stock"))
)
query("src_webhook", f"SELECT id, 'shopify' AS webhook_source FROM {_ITEMS}")(lambda s, d: _variant(s, d).select(records.field(c("p"), "handle").alias("id"), F.lit("shopify").alias("webhook_source")))

# CSV and XML

_LINE = "id || ',\"' || coalesce(title, '') || ', vol. 2\", ' || coalesce(doc_type, '')"
_CSV = lambda: F.concat(F.lit(" id,title,kind,extra\n"), F.expr(_LINE.replace("'\"", "'\"")))


def _lines(s, d):
    return _cms(s, d).select("id", F.expr(_LINE).alias("line"), _CSV().alias("p"))


query("csv_line_tokenizer", f"SELECT id, CAST(3 AS BIGINT) AS cells, trim(replace(coalesce(title, ''), '\"', '')) || ', vol. 2' AS second, trim(coalesce(doc_type, '')) AS third FROM {C}")(
    lambda s, d: _lines(s, d).withColumn("x", records.csv_cells(c("line"))).select("id", F.size("x").cast("bigint").alias("cells"), c("x")[1].alias("second"), c("x")[2].alias("third"))
)
query("src_csv_quoted", f"SELECT id, trim(replace(coalesce(title, ''), '\"', '')) || ', vol. 2' AS title, coalesce(nullif(trim(coalesce(doc_type, '')), ''), 'content') AS type, '' AS extra FROM {C}")(
    lambda s, d: records.csv_documents(_lines(s, d).select("p"), "p", {"title": "title", "type": "kind", "extra": "extra"}).select("id", *(c("metadata")[k].alias(k) for k in ("title", "type", "extra")))
)
query("src_csv_naive", f"SELECT string_split(line, ',')[1] AS id, trim(string_split(line, ',')[2]) AS title, CAST(len(string_split(line, ',')) AS BIGINT) AS cells FROM (SELECT {_LINE} AS line FROM {C})")(
    lambda s, d: records.csv_records(_lines(s, d).select("p", "line"), "p", ["line"], quoted=False).select(records.field(c("_item"), "id").alias("id"), records.field(c("_item"), "title").alias("title"), F.size(F.split("line", ",")).cast("bigint").alias("cells"))
)
_PLAIN = "trim(regexp_replace(coalesce(title, ''), '[<>&]', '', 'g'))"
_plain = lambda: F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), "[<>&]", ""))
query("src_xml", f"SELECT id, {_PLAIN} AS title, 'last' AS note FROM {C}")(
    lambda s, d: records.xml_documents(_cms(s, d).select(F.concat(F.lit("<items><ITEM n='1'><id>"), "id", F.lit("</id>\n<title> "), _plain(), F.lit(" </title><note>first</note><note>last</note></ITEM></items>")).alias("p")), "p", {"title": "title", "note": "note"}).select("id", *(c("metadata")[k].alias(k) for k in ("title", "note")))
)

# feeds

_rss = lambda: F.concat(F.lit("<rss><channel><item><title>"), _plain(), F.lit("</title><link>"), F.coalesce("url", F.lit("")), F.lit("</link><guid>"), "id", F.lit("</guid><description><![CDATA["), F.coalesce("content", F.lit("")), F.lit("]]></description><pubDate> today </pubDate><category>a</category><category> "), F.coalesce("doc_type", F.lit("")), F.lit("</category></item></channel></rss>"))
_atom = lambda: F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title type="text">'), _plain(), F.lit('</title><link rel="self" href="self"/><link rel="alternate" href="'), F.coalesce("url", F.lit("-")), F.lit('"/><id>'), "id", F.lit("</id><summary>"), _plain(), F.lit('</summary><author><name>N</name></author><updated>u</updated><category term="a"/><category term="'), F.coalesce("doc_type", F.lit("")), F.lit('"/></entry></feed>'))


def _feeds(s, d):
    return _cms(s, d).withColumn("xml", F.when(F.length("id") + F.coalesce(F.length("title"), F.lit(0)) > 30, _atom()).otherwise(_rss()))


_IS_ATOM = "length(id) + coalesce(length(title), 0) > 30"
query("parse_feed", f"""SELECT id AS guid, {_PLAIN} AS title, CASE WHEN {_IS_ATOM} THEN coalesce(url, '-') ELSE coalesce(url, '') END AS link, CASE WHEN {_IS_ATOM} THEN {_PLAIN} END AS content,
    CASE WHEN NOT {_IS_ATOM} THEN trim(coalesce(content, ''), e' \\t\\n\\r') END AS description, CASE WHEN {_IS_ATOM} THEN 'u' ELSE 'today' END AS published, CASE WHEN {_IS_ATOM} THEN 'N' END AS author, 'a|' || coalesce(doc_type, '') AS categories FROM {C}""")(
    lambda s, d: web.feed_items(_feeds(s, d), "xml").select("guid", "title", "link", "content", "description", "published", "author", F.array_join("categories", "|").alias("categories"))
)
query("xml_value", f"SELECT id, {_PLAIN} AS title, id AS key FROM {C}")(lambda s, d: _feeds(s, d).select("id", web.xml_value(c("xml"), "title").alias("title"), F.coalesce(web.xml_value(c("xml"), "guid"), web.xml_value(c("xml"), "id")).alias("key")))
query("xml_values", f"SELECT id, CAST(CASE WHEN {_IS_ATOM} THEN 2 ELSE 0 END AS BIGINT) AS terms, CAST(CASE WHEN {_IS_ATOM} THEN 0 ELSE 2 END AS BIGINT) AS filled FROM {C}")(
    lambda s, d: _feeds(s, d).select("id", F.size(web.xml_values(c("xml"), "category", "term")).cast("bigint").alias("terms"), F.size(web.xml_values(c("xml"), "category")).cast("bigint").alias("filled"))
)
query("atom_link", f"SELECT id, coalesce(url, '-') AS link FROM {C} WHERE {_IS_ATOM}")(lambda s, d: _feeds(s, d).where(F.length("id") + F.coalesce(F.length("title"), F.lit(0)) > 30).select("id", web.atom_link(c("xml")).alias("link")))
query("src_rss")(lambda s, d: web.feed_documents(web.feed_items(_cms(s, d).withColumn("xml", _rss()), "xml")))

# sitemaps and pages

_map = lambda: F.concat(F.lit("<urlset><url><loc> "), F.coalesce("url", F.lit("ftp://none")), F.lit(" </loc><lastmod>1</lastmod></url>\n<url><loc>https://www.example.org/"), "id", F.lit("</loc></url></urlset>"))


def _urls(s, d):
    return _cms(s, d).select("id", F.explode(web.sitemap_urls(_map())).alias("url"))


_URLS = f"(SELECT id, unnest([CASE WHEN url IS NOT NULL THEN url END, 'https://www.example.org/' || id]) AS url FROM {C})"
for _name in ("sitemap_loc_extract", "parse_sitemap"):
    query(_name, f"SELECT id, trim(url) AS url FROM {_URLS} WHERE url IS NOT NULL")(_urls)
query("filter_url_patterns", f"SELECT id, url FROM {_URLS} WHERE (contains(url, 'help.') OR contains(url, '/cms-')) AND NOT contains(url, 'policy')")(lambda s, d: _urls(s, d).where(web.wanted(c("url"), ["help.", "/cms-"], ["policy"])))
query("src_sitemap", f"SELECT count(*) FILTER (WHERE k <= 100) AS crawled, count(*) FILTER (WHERE k > 100) AS skipped FROM (SELECT row_number() OVER (ORDER BY url, id) AS k FROM {_URLS} WHERE contains(url, 'help.'))")(
    lambda s, d: _urls(s, d).where(web.wanted(c("url"), ["help."])).agg(F.count("*").alias("n")).select(F.least("n", F.lit(100)).cast("bigint").alias("crawled"), F.greatest(c("n") - 100, F.lit(0)).cast("bigint").alias("skipped"))
)
query("src_url_list", f"SELECT id, CASE WHEN contains(url, '/policy') THEN 'policy' WHEN contains(url, 'help.') THEN 'help' ELSE 'page' END AS kind FROM {C} WHERE url IS NOT NULL")(lambda s, d: _cms(s, d).where("url is not null").select("id", web.page_type(c("url"), {"/policy": "policy", "help.": "help"}).alias("kind")))


def _pages(s, d):
    html = F.concat(F.lit("<html><head><title>"), _plain(), F.lit("</title></head><body><nav>Home Shop</nav><article class='x'><p>"), F.regexp_replace(F.coalesce("content", F.lit("")), "[<>&]", " "), F.lit("</p></article><footer>bye</footer></body></html>"))
    return web.pages(_cms(s, d).select("id", html.alias("html")), "id", "html")


query("html_extract")(lambda s, d: _pages(s, d).where("content is not null"))
query("crawl_batches")(lambda s, d: _pages(s, d).agg(F.count_if(c("content").isNotNull()).alias("crawled"), F.count_if(c("content").isNull()).alias("skipped")))
query("set_concat_files", f"SELECT message_id, CAST(coalesce(len(attachments), 0) + 1 AS BIGINT) AS files FROM {M}")(lambda s, d: rows(s, d, "thread_messages", columns=["attachments"]).select("message_id", F.size(F.concat(F.coalesce("attachments", F.array().cast("array<string>")), F.array(F.lit("new.txt")))).cast("bigint").alias("files")))
