"""Transfer syntaxes and what writing with another one means (FLT-7, SNK-3/6, COD-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the public standard: UID, name, family, lossy.
SYNTAXES = """
1.2.840.10008.1.2 ImplicitVRLittleEndian native lossless
1.2.840.10008.1.2.1 ExplicitVRLittleEndian native lossless
1.2.840.10008.1.2.1.98 EncapsulatedUncompressedExplicitVRLittleEndian uncompressed lossless
1.2.840.10008.1.2.1.99 DeflatedExplicitVRLittleEndian native lossless
1.2.840.10008.1.2.2 ExplicitVRBigEndian native lossless
1.2.840.10008.1.2.4.50 JPEGBaseline8Bit jpeg lossy
1.2.840.10008.1.2.4.51 JPEGExtended12Bit jpeg lossy
1.2.840.10008.1.2.4.57 JPEGLossless jpeg lossless
1.2.840.10008.1.2.4.70 JPEGLosslessSV1 jpeg lossless
1.2.840.10008.1.2.4.80 JPEGLSLossless jpegls lossless
1.2.840.10008.1.2.4.81 JPEGLSNearLossless jpegls lossy
1.2.840.10008.1.2.4.90 JPEG2000Lossless jpeg2000 lossless
1.2.840.10008.1.2.4.91 JPEG2000 jpeg2000 lossy
1.2.840.10008.1.2.4.92 JPEG2000MCLossless jpeg2000 lossless
1.2.840.10008.1.2.4.93 JPEG2000MC jpeg2000 lossy
1.2.840.10008.1.2.4.100 MPEG2MPML mpeg2 lossy
1.2.840.10008.1.2.4.101 MPEG2MPHL mpeg2 lossy
1.2.840.10008.1.2.4.102 MPEG4HP41 h264 lossy
1.2.840.10008.1.2.4.103 MPEG4HP41BD h264 lossy
1.2.840.10008.1.2.4.104 MPEG4HP422D h264 lossy
1.2.840.10008.1.2.4.105 MPEG4HP423D h264 lossy
1.2.840.10008.1.2.4.106 MPEG4HP42STEREO h264 lossy
1.2.840.10008.1.2.4.107 HEVCMP51 hevc lossy
1.2.840.10008.1.2.4.108 HEVCM10P51 hevc lossy
1.2.840.10008.1.2.4.110 JPEGXLLossless jpegxl lossless
1.2.840.10008.1.2.4.111 JPEGXLJPEGRecompression jpegxl lossy
1.2.840.10008.1.2.4.112 JPEGXL jpegxl lossy
1.2.840.10008.1.2.4.201 HTJ2KLossless htj2k lossless
1.2.840.10008.1.2.4.202 HTJ2KLosslessRPCL htj2k lossless
1.2.840.10008.1.2.4.203 HTJ2K htj2k lossy
1.2.840.10008.1.2.5 RLELossless rle lossless
"""
IMPLICIT = "1.2.840.10008.1.2"
#: Families that this engine reads and writes by itself.
OWN = ("native", "uncompressed", "rle")


def syntaxes(spark) -> DataFrame:
    """A fixed small table, safe to broadcast: what a transfer syntax is, and whether it can be read and written here."""
    rows = [line.split() for line in SYNTAXES.split("\n") if line]
    kinds = "uid string, name string, family string, encapsulated boolean, explicit_vr boolean, uncompressed boolean, lossy boolean, can_decode boolean, can_encode boolean"
    return spark.createDataFrame([(u, n, f, f != "native", u != IMPLICIT, f in ("native", "uncompressed"), loss == "lossy", f in OWN, f in ("native", "rle")) for u, n, f, loss in rows], kinds)


def classified(instances: DataFrame, uid: str = "transfer_syntax_uid") -> DataFrame:
    """instances with their syntax's columns; null for an unknown syntax."""
    known = syntaxes(instances.sparkSession).withColumnRenamed("uid", "_uid")
    return instances.join(F.broadcast(known), F.col(uid) == F.col("_uid"), "left").drop("_uid")


def resolve(text: str) -> str | None:
    """The UID of a name or UID, without regard to case, spaces, dashes and underscores."""
    plain = lambda s: s.lower().translate(str.maketrans("", "", " -_"))
    return next((u for u, n, *_ in (line.split() for line in SYNTAXES.split("\n") if line) if plain(text) in (plain(u), plain(n))), None)


def decision(same: Column, source_encapsulated: Column, target_encapsulated: Column, overlay: Column) -> Column:
    return (
        F.when(same & overlay, "metadata_overlay").when(same, "as_is").when(~source_encapsulated & target_encapsulated, "native_to_encapsulated")
        .when(source_encapsulated & ~target_encapsulated, "encapsulated_to_native").when(source_encapsulated & target_encapsulated, "encapsulated_to_encapsulated").otherwise("native_to_native")
    )


def lossy_state(was: Column, lossy: Column) -> Column:
    """LossyImageCompression after an encode: once 01, always 01."""
    return F.when(lossy | (was == "01"), "01").otherwise("00")


def segmentation_target(lossy: Column) -> Column:
    return ~lossy


def lossy_history(methods: Column, ratios: Column, method: Column, ratio: Column) -> Column:
    """(methods, ratios) with a further encode: both lists are first cut to the pairs they have in common."""
    n = F.least(F.size(methods), F.size(ratios))
    return F.struct(F.concat(F.slice(methods, F.lit(1), n), F.array(method)).alias("methods"), F.concat(F.slice(ratios, F.lit(1), n), F.array(ratio)).alias("ratios"))


def colour_planes(samples: Column, target_family: Column, now: Column) -> Column:
    """PlanarConfiguration after an encode: none for one sample, 1 for RLE, else as it was or 0."""
    return F.when(samples > 1, F.when(target_family == "rle", 1).otherwise(F.coalesce(now, F.lit(0))))
