"""Standard and profile claims."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import det_id
from ..functions.vocabulary import PROFILE_PACKS, PROFILE_WORDS
from .classify import looks_like_profile, standard_label
from .links import first_by


def enabled_packs(names: list[str] | None = None) -> tuple:
    """The packs of a request: all by default, none for `none`; an unknown name is an error."""
    if not names:
        return PROFILE_PACKS
    if "none" in names:
        return ()
    unknown = sorted(set(names) - {p[0] for p in PROFILE_PACKS})
    if unknown:
        raise ValueError(f"unknown profile packs: {', '.join(unknown)}")
    return tuple(p for p in PROFILE_PACKS if p[0] in names)


def parse_packs(*texts: str) -> tuple:
    """Packs from TOML texts: id, label and standard_iri must be there; a pack whose IRI or label speaks of a profile, or that says `profile = true`, makes profile claims. Raises ValueError for what is no pack."""
    out = []
    for text in texts:
        pack = tomllib.loads(text)  # its error is a ValueError
        missing = [k for k in ("id", "label", "standard_iri") if not isinstance(pack.get(k), str)]
        if missing:
            raise ValueError(f"a profile pack needs {', '.join(missing)}")
        for name in ("artifact_kinds", "link_predicates"):
            if not all(isinstance(x, str) for x in pack.get(name, [])):
                raise ValueError(f"{name} of a profile pack must be strings")
        words = f"{pack['label']} {pack['standard_iri']}".lower()
        out.append((pack["id"], pack["label"], pack["standard_iri"], bool(pack.get("profile", any(w in words for w in PROFILE_WORDS)))))
    return tuple(out)


def with_pack(claims: DataFrame, packs: tuple = PROFILE_PACKS) -> DataFrame:
    """claims (iri) with label and is_profile: from the first pack whose IRI is the claim's, above or below it; else from the IRI's words."""
    iri = F.lower(F.rtrim(F.col("iri"), F.lit("/")))
    label, profile = [], []
    for _, name, pack_iri, is_profile in packs:
        own = pack_iri.rstrip("/").lower()
        fits = (iri == own) | iri.startswith(f"{own}/") | F.startswith(F.lit(own), F.concat(iri, F.lit("/")))
        label.append(F.when(fits, F.lit(name)))
        profile.append(F.when(fits, F.lit(is_profile)))
    return claims.withColumns({"label": F.coalesce(*label, standard_label(F.col("iri"))), "is_profile": F.coalesce(*profile, looks_like_profile(F.col("iri")))})


def claims(raw: DataFrame, packs: tuple = PROFILE_PACKS) -> tuple[DataFrame, DataFrame]:
    """(standards, profiles) from rows run_id, artifact_id, iri, version, predicate, base, title, ordinal, seq; the first of an artifact and IRI stays."""
    known = with_pack(raw, packs).withColumn("id", det_id("claim", "artifact_id", "iri"))
    known = known.withColumns({"is_profile": F.col("is_profile") | F.col("base").isNotNull(), "label": F.when(F.col("base").isNotNull(), F.col("title")).otherwise(F.col("label"))})
    once = lambda f: first_by(f, ["run_id", "id"], ["ordinal", "seq"])
    return once(known.where("not is_profile")).drop("base", "is_profile", "title"), once(known.where("is_profile")).withColumnRenamed("base", "base_standard_iri").drop("is_profile", "title")
