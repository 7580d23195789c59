"""Clock texts, number lists, asset paths, blind codes and split keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the salt that makes blind codes comparable between studies.
BLIND_SALT = "classroom_engagement_v2"
# The folder names under which assets are looked up.
DATA_PREFIX = "data/"
DATA_ASSETS = "data/assets/"
ASSETS = "assets/"
CROPS = "assets/crops/"
POSES = "assets/poses/"


def parse_clock(text: Column) -> Column:
    """``"s"``, ``"mm:ss"`` or ``"hh:mm:ss"`` as seconds; NULL where it is none of them."""
    parts = F.split(F.trim(text), ":")
    n = F.size(parts)
    seconds = F.try_element_at(parts, n).try_cast("double")
    minutes = F.try_element_at(parts, n - 1).try_cast("int")
    hours = F.try_element_at(parts, n - 2).try_cast("int")
    return (
        F.when(n == 1, F.get(parts, F.lit(0)).try_cast("double"))
        .when(n == 2, F.when(n > 1, minutes) * 60.0 + seconds)
        .when(n == 3, F.when(n > 2, hours) * 3600.0 + minutes * 60.0 + seconds)
    )


def clock_text(seconds: Column) -> Column:
    """``h:mm:ss.cc`` with half-even hundredths; a full hundred carries into the seconds only."""
    total = F.greatest(F.lit(0.0), seconds.cast("double"))
    hours = F.floor(total / 3600)
    rest = total - hours * 3600
    minutes = F.floor(rest / 60)
    rest = rest - minutes * 60
    whole = F.floor(rest)
    hundredths = F.rint((rest - whole) * 100).cast("int")
    carry = hundredths >= 100
    return F.format_string(
        "%d:%02d:%02d.%02d", hours, minutes,
        F.when(carry, whole + 1).otherwise(whole),
        F.when(carry, hundredths - 100).otherwise(hundredths),
    )


def number_list(text: Column) -> Column:
    """Comma list as distinct ascending numbers; NULL when empty or when a number is negative or unreadable."""
    items = F.filter(F.transform(F.split(text, ","), lambda s: F.trim(s)), lambda s: s != "")
    values = F.array_sort(F.array_distinct(F.transform(items, lambda s: s.try_cast("double"))))
    valid = (F.size(values) > 0) & ~F.exists(values, lambda v: v.isNull() | (v < 0))
    return F.when(valid, values)


def clean_path(path: Column) -> Column:
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def under(root: Column, relative: Column) -> Column:
    return F.concat_ws("/", F.rtrim(root, F.lit("/")), relative)


def asset_candidates(path: Column, dataset_root: Column, store_dir: Column) -> Column:
    """Places an asset may lie, most preferred first; the caller keeps the first that exists."""
    p = clean_path(path)
    name = base_name(p)
    store_parent = F.regexp_replace(F.rtrim(store_dir, F.lit("/")), "/[^/]*$", "")
    none = F.lit(None).cast("string")
    listed = F.array(
        F.when(p.startswith("/"), p).otherwise(none),
        under(dataset_root, p),
        under(store_dir, p),
        under(store_parent, p),
        F.when(p.contains(DATA_ASSETS), under(dataset_root, F.replace(p, F.lit(DATA_ASSETS), F.lit(ASSETS)))).otherwise(none),
        F.when(p.startswith(DATA_PREFIX), under(dataset_root, F.substr(p, F.lit(len(DATA_PREFIX) + 1)))).otherwise(none),
        F.when(name != "", under(dataset_root, F.concat(F.lit(CROPS), name))).otherwise(none),
        F.when(name != "", under(dataset_root, F.concat(F.lit(POSES), name))).otherwise(none),
    )
    return F.when(p != "", F.array_distinct(F.array_compact(listed)))


def blind_code(rater: Column, segment_id: Column) -> Column:
    text = F.concat_ws(":", rater, segment_id.cast("string"), F.lit(BLIND_SALT))
    return F.upper(F.substring(F.sha2(text, 256), 1, 12))


def content_fingerprint(content: Column) -> Column:
    return F.sha2(content, 256)


def window_group(dataset: Column, video: Column, start: Column, end: Column) -> Column:
    return F.format_string("window:%s:%d:%.6f:%.6f", dataset.cast("string"), video, start, end)


def dataset_group(dataset: Column) -> Column:
    return F.concat(F.lit("dataset:"), dataset.cast("string"))


def session_group(school: Column, session: Column) -> Column:
    return F.concat_ws(":", F.lit("session"), school, session)


def school_group(school: Column) -> Column:
    return F.concat(F.lit("school:"), school)
