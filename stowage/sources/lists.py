"""Lists of installed programs as other programs write them: JSON in several layouts, items, libraries and running apps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import quoted
from stowage.operators.paths import normal_path

ENTRY = "struct<title:string,install_path:string,app_name:string,appName:string,version:string,build_id:string,buildId:string,install_size:bigint>"
ITEM = "AppName string, DisplayName string, InstallLocation string, AppVersionString string, bIsApplication boolean, bIsIncompleteInstall boolean"
#: Larger texts are not read, and names are not looked for deeper.
MOST_BYTES, MOST_DEPTH = 16 * 1024 * 1024, 16


def absolute(path: Column) -> Column:
    return F.startswith(path, F.lit("/")) | path.rlike(r"^[A-Za-z]:[/\\]")


def document_status(text: Column, most: int = MOST_BYTES) -> Column:
    """read, large (not looked at) or corrupt (to be set aside); null texts are missing."""
    return F.when(text.isNull(), "missing").when(F.octet_length(text) > most, "large").when(F.try_parse_json(text).isNull(), "corrupt").otherwise("read")


def installed_entries(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, id, title, path, build, size) of lists that are an array or an object, at the top or under `installed`.

    An id is the entry's name, else its key in an object, else its path (places in an array are none). Titles fall back to the
    folder's name, then the id. Entries without an absolute path are left out, and so are texts that are no such list.
    """
    inner = F.coalesce(F.get_json_object(F.col(quoted(text)), "$.installed"), F.col(quoted(text)))
    listed = F.transform(F.from_json(inner, f"array<{ENTRY}>"), lambda e: F.struct(F.lit(None).cast("string").alias("k"), e.alias("e")))
    keyed = F.transform(F.map_entries(F.from_json(inner, f"map<string,{ENTRY}>")), lambda x: F.struct(x["key"].alias("k"), x["value"].alias("e")))
    rows = df.where(document_status(F.col(quoted(text))) == "read").select(F.col(quoted(key)).alias(key), F.posexplode(F.when(F.startswith(F.ltrim(inner), F.lit("[")), listed).otherwise(keyed)).alias("ord", "x"))
    path = F.col("x.e.install_path")
    name = F.coalesce(F.nullif(F.coalesce("x.e.app_name", "x.e.appName"), F.lit("")), "x.k", path)
    title = F.coalesce(F.col("x.e.title"), F.nullif(F.element_at(F.split(normal_path(path), "/"), -1), F.lit("")), name)
    return rows.where(path.isNotNull() & absolute(path)).select(key, "ord", name.alias("id"), title.alias("title"), path.alias("path"), F.coalesce("x.e.version", "x.e.build_id", "x.e.buildId").alias("build"), F.col("x.e.install_size").alias("size"))


def item_manifests(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, title, path, build, state, warning) of single items. What says it is no application is left out; what lacks a field is a warning; an incomplete install is busy."""
    rows = df.select(F.col(quoted(key)).alias(key), F.from_json(F.col(quoted(text)), ITEM).alias("i"))
    rows = rows.where(F.coalesce(F.col("i.bIsApplication"), F.lit(True)))
    missing = F.when(F.col("i.AppName").isNull(), "Missing AppName").when(F.col("i.DisplayName").isNull(), "Missing DisplayName").when(F.col("i.InstallLocation").isNull(), "Missing InstallLocation").when(~absolute(F.col("i.InstallLocation")), "Relative path")
    good = missing.isNull()
    keep = lambda c: F.when(good, F.col(f"i.{c}"))
    return rows.select(key, keep("AppName").alias("id"), keep("DisplayName").alias("title"), keep("InstallLocation").alias("path"), keep("AppVersionString").alias("build"), F.when(good, F.when(F.coalesce(F.col("i.bIsIncompleteInstall"), F.lit(False)), "busy").otherwise("idle")).alias("state"), missing.alias("warning"))


def library_folders(entries: DataFrame, key: str, roots: Column) -> DataFrame:
    """(key, place, folder): the root first, then the folders of a library list, in the nested and in the old flat form, each once.

    entries: of text.key_values. A root is a library even if its list can't be read.
    """
    nested = F.col("path").rlike("^libraryfolders/[^/]+$") & (F.lower("name") == "path")
    flat = (F.col("path") == "libraryfolders") & F.col("name").rlike(r"^\d+$")
    found = entries.where((nested | flat) & F.col("value").isNotNull()).select(key, F.col("ord"), normal_path(F.col("value")).alias("folder"))
    own = entries.select(key).distinct().select(key, F.lit(-1).alias("ord"), normal_path(roots).alias("folder"))
    first = own.unionAll(found).groupBy(key, "folder").agg(F.min("ord").alias("ord"))
    return first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "folder"))).alias("all")).select(key, F.posexplode("all").alias("place", "x")).select(key, "place", F.col("x.folder").alias("folder"))


def value_by_name(entries: DataFrame, key: str, name: str, depth: int = MOST_DEPTH) -> DataFrame:
    """(key, value) of the first entry with a name (case aside), however deep down to `depth`."""
    levels = F.when(F.col("path") == "", 0).otherwise(F.size(F.split("path", "/")))
    found = entries.where((F.lower("name") == name.lower()) & F.col("value").isNotNull() & (levels <= depth))
    return found.groupBy(key).agg(F.min_by("value", "ord").alias("value"))


def value_at(entries: DataFrame, key: str, *chain: str) -> DataFrame:
    """(key, value) at the end of a chain of names (case aside); the first one if it is there more than once."""
    found = entries.where((F.col("path") == "/".join(c.lower() for c in chain[:-1])) & (F.lower("name") == chain[-1].lower()) & F.col("value").isNotNull())
    return found.groupBy(key).agg(F.min_by("value", "ord").alias("value"))


def running_app(entries: DataFrame, key: str, name: str = "RunningAppID") -> DataFrame:
    """(key, app) of the first text by key that names an app which is running; no row if none does."""
    numbers = value_by_name(entries, key, name).select(key, F.col("value").try_cast("bigint").alias("app")).where("app > 0")
    return numbers.orderBy(key).limit(1)
