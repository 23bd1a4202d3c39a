"""Catalogue, edits, publishing, sessions and access as relational operators over immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions.text import blank_to_null, front_matter, strip


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order (best last)."""
    newest = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, by: list[str], updated: str = "updated_at", created: str = "created_at") -> DataFrame:
    """Old and new rows merged by key: the latest values, the earliest creation time."""
    every = old.unionByName(new, allowMissingColumns=True)
    first = F.min(created).over(Window.partitionBy(*by))
    return latest(every.withColumn("_first", first), by, [F.col(updated).desc(), F.col(created).desc()]).withColumn(created, F.col("_first")).drop("_first")


def partial_update(rows: DataFrame, changes: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Rows with the changed columns set. `changes` has a flag `set_<column>` beside each column, so null can be set."""
    renamed = changes.select(*by, *[F.col(c).alias(f"_{c}") for c in columns], *[f"set_{c}" for c in columns])
    out = rows.join(renamed, by, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.coalesce(f"set_{c}", F.lit(False)), F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_{c}" for c in columns], *[f"set_{c}" for c in columns])


def delete_by(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    return rows.join(keys.select(*by).distinct(), by, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the rows of deleted keys."""
    return delete_by(parents, gone, [key]), delete_by(children, gone, [key])


def review(requests: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """Requests with their decision (status, reviewed_by, reviewed_at, review_note) applied; one that isn't pending any
    more keeps its state and is marked as a conflict."""
    names = ["status", "reviewed_by", "reviewed_at", "review_note"]
    named = decisions.select(*by, *[F.col(c).alias(f"_{c}") for c in names])
    both = requests.join(named, by, "left")
    decided = F.col("_status").isNotNull()
    apply = decided & (F.col("status") == "pending")
    out = both.withColumn("conflict", decided & (F.col("status") != "pending"))
    for c in reversed(names):
        out = out.withColumn(c, F.when(apply, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.drop(*[f"_{c}" for c in names])


def request_publish(requests: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Requests with new ones merged in: a repeated request is pending again and loses its review."""
    fresh = new.withColumn("status", F.lit("pending")).withColumns({c: F.lit(None).cast(requests.schema[c].dataType) for c in ("reviewed_by", "reviewed_at", "review_note")})
    return upsert(requests, fresh, by)


def session_list(sessions: DataFrame, messages: DataFrame, owner: str | None = None, limit: int | None = None) -> DataFrame:
    """Sessions with the time of their last message, the most recent first."""
    mine = sessions if owner is None else sessions.where(F.col("owner_id") == owner)
    last = messages.groupBy("session_id").agg(F.max("created_at").alias("last_message_at"))
    out = mine.join(last, "session_id", "left").withColumn("recency", F.coalesce("last_message_at", "created_at")).orderBy(F.col("recency").desc(), "session_id")
    return out if limit is None else out.limit(limit)


def history(messages: DataFrame, by: str, order: list[str], fetch: int = 20, keep: int = 10, mode: str = "reference") -> DataFrame:
    """Messages that a conversation passes on: the last `keep` of its oldest `fetch` (`reference`), or of all (`latest`)."""
    forward = Window.partitionBy(by).orderBy(*order)
    numbered = messages.withColumn("_n", F.row_number().over(forward))
    if mode == "reference":
        numbered = numbered.where(F.col("_n") <= fetch)
    elif mode != "latest":
        raise ValueError(f"unknown mode {mode}")
    size = F.count(F.lit(1)).over(Window.partitionBy(by))
    return numbered.withColumn("_all", size).where(F.col("_n") > F.col("_all") - keep).drop("_n", "_all")


def effective_markdown(pages: DataFrame, edits: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Text that a page shows: its published edit, else its own, without front matter."""
    live = edits.where("status = 'published'").select(*by, F.col("content_md").alias("_edit"))
    shown = F.coalesce("_edit", text)
    return pages.join(live, by, "left").select(*by, front_matter(shown)["body"].alias("markdown"), F.col("_edit").isNotNull().alias("edited"))


def catalog_counts(pages: DataFrame, custom: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Docs with their number of pages, origin and exclusion. Every custom page counts, also one that is ingested."""
    own = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("own"))
    more = custom.groupBy("doc_id").agg(F.count(F.lit(1)).alias("more"))
    both = own.join(more, "doc_id", "full_outer").join(exclusions.select("doc_id").distinct().withColumn("excluded", F.lit(True)), "doc_id", "left")
    return both.select(
        "doc_id",
        (F.coalesce("own", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_pages"),
        F.when(F.col("own").isNull(), "custom").otherwise("ingested").alias("origin"),
        F.coalesce("excluded", F.lit(False)).alias("excluded"),
    )


def catalog_listing(counts: DataFrame, titles: DataFrame, order: str = "place") -> DataFrame:
    """Docs as they are listed, numbered in `nth`: ingested ones as they came (`order` of titles), then custom ones by title.

    titles: (doc_id, doc_title, order). There are as many rows as docs, so they are numbered in one task.
    """
    named = counts.join(titles.select("doc_id", "doc_title", F.col(order).alias("_place")), "doc_id", "left").withColumn("doc_title", F.coalesce("doc_title", F.col("doc_id").cast("string")))
    custom = F.col("origin") == "custom"
    by = [custom, F.when(~custom, F.col("_place")), F.when(custom, F.lower("doc_title")), F.col("doc_id")]
    return named.withColumn("nth", F.row_number().over(Window.orderBy(*by))).drop("_place")


# How the application's tables are listed.
ORDERINGS = {"users": [("created_at", True)], "settings": [("key", True)], "custom_pages": [("doc_id", True), ("page_title", True)], "doc_pages": [("page_title", True)], "requests": [("updated_at", False)]}


def listed(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of the application's tables in the order in which they are listed."""
    return rows.orderBy(*[F.col(c).asc() if up else F.col(c).desc() for c, up in ORDERINGS[kind]])


def catalog_detail(pages: DataFrame, custom: DataFrame, by: list[str]) -> DataFrame:
    """All pages: the ingested ones, and the custom ones that aren't among them."""
    return pages.withColumn("origin", F.lit("ingested")).unionByName(custom.join(pages.select(*by), by, "left_anti").withColumn("origin", F.lit("custom")), allowMissingColumns=True)


def resolve_page(pages: DataFrame, custom: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Each page as it is found: the ingested one, else the custom one."""
    one = pages.select(*by, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_a"))
    two = custom.select(*by, *[F.col(c).alias(f"_b_{c}") for c in columns])
    both = one.join(two, by, "full_outer")
    picked = [F.when(F.col("_a"), F.col(f"_a_{c}")).otherwise(F.col(f"_b_{c}")).alias(c) for c in columns]
    return both.select(*by, *picked, F.when(F.col("_a"), "ingested").otherwise("custom").alias("origin"))


def publish_queue(requests: DataFrame, users: DataFrame, version: str | None = None, status: str | None = None) -> DataFrame:
    """Requests with the names of author and reviewer; filters apply where they are given."""
    out = requests
    for column, value in (("version", version), ("status", status)):
        if value is not None:
            out = out.where(F.col(column) == value)
    for column in ("author_id", "reviewed_by"):
        names = users.select(F.col("user_id").alias(column), F.col("username").alias(f"{column}_name"))
        out = out.join(names, column, "left")
    return out


def guide(pages: DataFrame, by: str, order: str, title: str, text: str) -> DataFrame:
    """One text per guide: pages in order, each after a section marker; only the first keeps its front matter.

    A guide's pages meet in one row, so this is for guides, whose size is bounded, and not for a whole corpus.
    """
    first = F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1
    body = F.when(first, F.col(text)).otherwise(front_matter(F.col(text))["body"])
    marked = F.concat(F.lit("[[DOC_SECTION: "), F.col(title).cast("string"), F.lit("]]\n"), body)
    each = pages.select(by, F.col(order).alias("_o"), marked.alias("_m"))
    return each.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_o", "_m"))).alias("_all")).select(by, F.array_join(F.transform("_all", lambda x: x["_m"]), "\n").alias("markdown"))


def allowed_docs(rows: DataFrame, role: Column, restricted: list[str], doc: str = "doc_id") -> DataFrame:
    """Rows that a role may see: staff see all, clients and anonymous readers not the restricted docs."""
    return rows.where(role.isin("admin", "redactor", "support") | ~F.col(doc).isin(restricted))


def default_permissions(role: Column) -> Column:
    """What a new user may do, by role."""
    edit, publish = role.isin("admin", "redactor", "support"), role == "admin"
    return F.struct(edit.cast("int").alias("docs_edit"), publish.cast("int").alias("docs_publish"))


def active_admins(users: DataFrame) -> DataFrame:
    """One row: number of admins that aren't disabled."""
    return users.where((F.col("role") == "admin") & (F.coalesce("disabled_at", F.lit("")) == "")).agg(F.count(F.lit(1)).alias("n"))


def find_user(users: DataFrame, login: Column) -> DataFrame:
    """The user of a login name: by user name, else, where it has an @, by address."""
    name = F.lower(strip(login))
    hit = F.when(F.lower("username") == name, 1).when(F.contains(name, F.lit("@")) & (F.lower("email") == name), 2)
    return users.withColumn("_hit", hit).where("_hit is not null").orderBy("_hit").limit(1).drop("_hit")


def not_expired(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(F.col("expires_at") >= now)


def visible_sessions(sessions: DataFrame, user: str, role: str) -> DataFrame:
    """A user's own sessions; those without an owner (`legacy`) for admins only."""
    own = F.col("owner_id") == user
    return sessions.where(own | (F.col("owner_id") == "legacy")) if role == "admin" else sessions.where(own)


def overlay(defaults: Column, stored: Column) -> Column:
    """Settings as maps: stored keys replace default ones, at the top level only."""
    kept = F.map_filter(defaults, lambda k, v: ~F.map_contains_key(stored, k))
    return F.map_concat(kept, stored)


def merge_missing(stored: object, defaults: object) -> object:
    """Stored settings with the defaults that they lack, at every level; what is stored is never changed."""
    if not isinstance(stored, dict) or not isinstance(defaults, dict):
        return stored
    return {**{k: merge_missing(v, defaults[k]) if k in defaults else v for k, v in stored.items()}, **{k: v for k, v in defaults.items() if k not in stored}}


def system_prompt(settings: dict, role: str) -> str:
    """The prompt template of a role (`anonymous` if blank), else the single template; neither is an error."""
    for found in ((settings.get("system_prompt_templates") or {}).get((role or "").strip() or "anonymous"), settings.get("system_prompt_template")):
        if isinstance(found, str) and found.strip():
            return found
    raise ValueError("no system prompt template is set")


def migrated_users(users: DataFrame) -> DataFrame:
    """User rows of an older layout: blanks to null, roles in lower case, permissions by role where missing."""
    role = F.coalesce(F.lower(blank_to_null(F.col("role"))), F.lit("client"))
    fallback = default_permissions(role)
    return users.withColumns(
        {
            "email": F.lower(blank_to_null(F.col("email"))),
            "role": role,
            "docs_edit": F.coalesce("docs_edit", fallback["docs_edit"]),
            "docs_publish": F.coalesce("docs_publish", fallback["docs_publish"]),
        }
    )


def free_suffix(names: DataFrame, taken: DataFrame, name: str = "name") -> DataFrame:
    """(name, unique): the name if it is free, else the name with the smallest free number, `-1` first."""
    same = taken.select(F.col(name).alias("_t")).distinct()
    base = F.regexp_replace("_t", r"-\d+$", "")
    number = F.when(F.col("_t").rlike(r"-[1-9]\d{0,8}$"), F.regexp_extract("_t", r"-(\d+)$", 1).cast("int"))
    plain = same.select(F.col("_t").alias(name), F.lit(True).alias("_plain"))
    used = same.where(number.isNotNull()).select(base.alias(name), number.alias("_u")).groupBy(name).agg(F.array_sort(F.collect_set("_u")).alias("_used"))
    used = used.join(names.select(name).distinct(), name, "left_semi")
    gap = F.element_at(F.array_except(F.sequence(F.lit(1), F.size(F.coalesce("_used", F.array().cast("array<int>"))) + 1), F.coalesce("_used", F.array().cast("array<int>"))), 1)
    both = names.join(plain, name, "left").join(used, name, "left")
    return both.select(name, F.when(F.col("_plain"), F.concat_ws("-", name, gap.cast("string"))).otherwise(F.col(name)).alias("unique"))
