"""Tags, value representations and the element dictionary (UID-1, JON-1, FLT-2..4)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the public standard: keyword, tag, value representation.
DICTIONARY = """
FileMetaInformationGroupLength 00020000 UL
FileMetaInformationVersion 00020001 OB
MediaStorageSOPClassUID 00020002 UI
MediaStorageSOPInstanceUID 00020003 UI
TransferSyntaxUID 00020010 UI
ImplementationClassUID 00020012 UI
ImplementationVersionName 00020013 SH
SpecificCharacterSet 00080005 CS
ImageType 00080008 CS
SOPClassUID 00080016 UI
SOPInstanceUID 00080018 UI
StudyDate 00080020 DA
Modality 00080060 CS
Manufacturer 00080070 LO
StudyDescription 00081030 LO
SeriesDescription 0008103E LO
ReferencedSOPClassUID 00081150 UI
ReferencedSOPInstanceUID 00081155 UI
PatientName 00100010 PN
PatientID 00100020 LO
PatientBirthDate 00100030 DA
PatientAge 00101010 AS
PatientComments 00104000 LT
TextValue 0040A160 UT
SliceThickness 00180050 DS
SpacingBetweenSlices 00180088 DS
StudyInstanceUID 0020000D UI
SeriesInstanceUID 0020000E UI
InstanceNumber 00200013 IS
ImagePositionPatient 00200032 DS
ImageOrientationPatient 00200037 DS
FrameOfReferenceUID 00200052 UI
StackID 00209056 SH
InStackPositionNumber 00209057 UL
SamplesPerPixel 00280002 US
PhotometricInterpretation 00280004 CS
PlanarConfiguration 00280006 US
NumberOfFrames 00280008 IS
Rows 00280010 US
Columns 00280011 US
PixelSpacing 00280030 DS
BitsAllocated 00280100 US
BitsStored 00280101 US
HighBit 00280102 US
PixelRepresentation 00280103 US
WindowCenter 00281050 DS
WindowWidth 00281051 DS
RescaleIntercept 00281052 DS
RescaleSlope 00281053 DS
LossyImageCompression 00282110 CS
SegmentSequence 00620002 SQ
SegmentNumber 00620004 US
SegmentLabel 00620005 LO
SharedFunctionalGroupsSequence 52009229 SQ
PerFrameFunctionalGroupsSequence 52009230 SQ
RTVCommunicationSOPInstanceUID 00020033 UI
ReferencedSOPInstanceUIDInFile 00041511 UI
InstanceCreationDate 00080012 DA
AccessionNumber 00080050 SH
MultiFrameSourceSOPInstanceUID 00081167 UI
SourceImageSequence 00082112 SQ
DerivationImageSequence 00089124 SQ
VolumetricProperties 00089206 CS
SOPInstanceUIDOfConcatenationSource 00200242 UI
SynchronizationFrameOfReferenceUID 00200200 UI
FrameContentSequence 00209111 SQ
PlanePositionSequence 00209113 SQ
PlaneOrientationSequence 00209116 SQ
DimensionIndexValues 00209157 UL
DimensionIndexSequence 00209222 SQ
VolumeFrameOfReferenceUID 00209312 UI
TableFrameOfReferenceUID 00209313 UI
FrameIncrementPointer 00280009 AT
NumberOfSegments 00280120 US
WindowCenterWidthExplanation 00281055 LO
VOILUTFunction 00281056 CS
RedPaletteColorLookupTableDescriptor 00281101 US
GreenPaletteColorLookupTableDescriptor 00281102 US
BluePaletteColorLookupTableDescriptor 00281103 US
RedPaletteColorLookupTableData 00281201 OW
GreenPaletteColorLookupTableData 00281202 OW
BluePaletteColorLookupTableData 00281203 OW
AlphaPaletteColorLookupTableDescriptor 00281104 US
AlphaPaletteColorLookupTableData 00281204 OW
SegmentedRedPaletteColorLookupTableData 00281221 OW
SegmentedGreenPaletteColorLookupTableData 00281222 OW
SegmentedBluePaletteColorLookupTableData 00281223 OW
LossyImageCompressionRatio 00282112 DS
LossyImageCompressionMethod 00282114 CS
ModalityLUTSequence 00283000 SQ
LUTDescriptor 00283002 US
LUTData 00283006 OW
VOILUTSequence 00283010 SQ
PixelMeasuresSequence 00289110 SQ
FrameVOILUTSequence 00289132 SQ
PixelValueTransformationSequence 00289145 SQ
SliceVector 00540080 US
SegmentationType 00620001 CS
SegmentAlgorithmType 00620008 CS
SegmentIdentificationSequence 0062000A SQ
ReferencedSegmentNumber 0062000B US
MaximumFractionalValue 0062000E US
SegmentationFractionalType 00620010 CS
SourceFrameOfReferenceUID 00640003 UI
ReferencedFrameOfReferenceUID 30060024 UI
RelatedFrameOfReferenceUID 300600C2 UI
EquipmentFrameOfReferenceUID 300A0675 UI
OverlayRows 60xx0010 US
ExtendedOffsetTable 7FE00001 OV
ExtendedOffsetTableLengths 7FE00002 OV
FloatPixelData 7FE00008 OF
DoubleFloatPixelData 7FE00009 OD
PixelData 7FE00010 OW
"""
ENTRIES = [tuple(line.split()) for line in DICTIONARY.split("\n") if line]
EXACT = {t: (k, v) for k, t, v in ENTRIES if "x" not in t}
WILD = [(re.compile(t.replace("x", "[0-9A-F]")), k, v) for k, t, v in ENTRIES if "x" in t]

#: Value representations by class (fixed values).
STRING_VRS = "AE AS CS DA DS DT IS LO LT PN SH ST TM UC UI UR UT".split()
BINARY_VRS = "AT FD FL OB OD OF OL OV OW SL SS SV UL UN US UV".split()
CHARSET_VRS = "LO LT PN SH ST UC UT".split()
MULTI_VRS = "AE AS CS DA DS DT IS LO PN SH TM UC UI".split()
WIDTHS = {"AT": 4, "US": 2, "SS": 2, "UL": 4, "SL": 4, "UV": 8, "SV": 8, "FL": 4, "FD": 8}


def lookup(tag: str) -> tuple[str, str] | None:
    """(keyword, value representation) of 8 hex digits: exact entries first, then repeating groups."""
    return EXACT.get(tag) or next(((k, v) for p, k, v in WILD if p.fullmatch(tag)), None)


def tag_of(text: str) -> str | None:
    """8 hex digits of `GGGGEEEE`, `GGGG,EEEE`, `(GGGG,EEEE)` or a keyword."""
    m = re.fullmatch(r"\(?([0-9A-Fa-f]{4}),?([0-9A-Fa-f]{4})\)?", text)
    return (m[1] + m[2]).upper() if m else next((t for k, t, _ in ENTRIES if k == text), None)


def load(path: str) -> int:
    """Adds the entries of a text file (keyword, tag and VR a line, in the format above; x stands for any digit) and gives their number. Workers that parse need it, too."""
    with open(path, encoding="utf-8") as f:
        new = [tuple(line.split()[:3]) for line in f if line.strip() and not line.startswith("#")]
    for entry in new:
        if len(entry) != 3 or not re.fullmatch("[0-9A-Fa-fx]{8}", entry[1]):
            raise ValueError(f"bad entry {entry}")
    for keyword, tag, vr in new:
        ENTRIES.append((keyword, tag := tag.upper().replace("X", "x"), vr))
        if "x" in tag:
            WILD.append((re.compile(tag.replace("x", "[0-9A-F]")), keyword, vr))
        else:
            EXACT[tag] = keyword, vr
    return len(new)


def dictionary(spark: SparkSession) -> DataFrame:
    """(keyword, tag_hex, vr): a fixed small table, safe to broadcast."""
    return spark.createDataFrame(ENTRIES, "keyword string, tag_hex string, vr string")


def normalize_tag(text: Column) -> Column:
    """8 upper-case hex digits of a written tag, else null."""
    bare = F.upper(F.regexp_replace(text, r"[(),]", ""))
    return F.when(bare.rlike("^[0-9A-F]{8}$"), bare)


def tag_number(tag_hex: Column) -> Column:
    return F.conv(tag_hex, 16, 10).cast("long")


#: Storage classes by name (fixed values of the public standard).
STORAGE = """
ComputedRadiographyImageStorage 1.2.840.10008.5.1.4.1.1.1
DigitalXRayImageStorageForPresentation 1.2.840.10008.5.1.4.1.1.1.1
CTImageStorage 1.2.840.10008.5.1.4.1.1.2
EnhancedCTImageStorage 1.2.840.10008.5.1.4.1.1.2.1
UltrasoundMultiFrameImageStorage 1.2.840.10008.5.1.4.1.1.3.1
MRImageStorage 1.2.840.10008.5.1.4.1.1.4
EnhancedMRImageStorage 1.2.840.10008.5.1.4.1.1.4.1
UltrasoundImageStorage 1.2.840.10008.5.1.4.1.1.6.1
SecondaryCaptureImageStorage 1.2.840.10008.5.1.4.1.1.7
XRayAngiographicImageStorage 1.2.840.10008.5.1.4.1.1.12.1
NuclearMedicineImageStorage 1.2.840.10008.5.1.4.1.1.20
SegmentationStorage 1.2.840.10008.5.1.4.1.1.66.4
LabelMapSegmentationStorage 1.2.840.10008.5.1.4.1.1.66.7
EncapsulatedPDFStorage 1.2.840.10008.5.1.4.1.1.104.1
PositronEmissionTomographyImageStorage 1.2.840.10008.5.1.4.1.1.128
EnhancedPETImageStorage 1.2.840.10008.5.1.4.1.1.130
RTImageStorage 1.2.840.10008.5.1.4.1.1.481.1
RTDoseStorage 1.2.840.10008.5.1.4.1.1.481.2
RTStructureSetStorage 1.2.840.10008.5.1.4.1.1.481.3
RTPlanStorage 1.2.840.10008.5.1.4.1.1.481.5
VerificationSOPClass 1.2.840.10008.1.1
MediaStorageDirectoryStorage 1.2.840.10008.1.3.10
"""
UIDS = {uid: name for name, uid in (line.split() for line in STORAGE.split("\n") if line)}


def uid_names(spark: SparkSession) -> DataFrame:
    """(uid, name, kind): storage classes and transfer syntaxes, a fixed small table, safe to broadcast."""
    from ..operators.transcode import SYNTAXES

    syntaxes = [(u, n, "transfer syntax") for u, n, *_ in (line.split() for line in SYNTAXES.split("\n") if line)]
    return spark.createDataFrame([*((u, n, "storage class") for u, n in UIDS.items()), *syntaxes], "uid string, name string, kind string")


def with_uid_names(rows: DataFrame, uid: str) -> DataFrame:
    """rows with the name and kind of a UID column; null for an unknown one."""
    known = uid_names(rows.sparkSession).select(F.col("uid").alias("_uid"), F.col("name").alias("uid_name"), F.col("kind").alias("uid_kind"))
    return rows.join(F.broadcast(known), F.col(uid) == F.col("_uid"), "left").drop("_uid")


def uid_of(name: str) -> str | None:
    """A UID by its name."""
    return next((u for u, n in UIDS.items() if n == name), None)


def is_segmentation(sop_class: Column) -> Column:
    """Segmentations of either class."""
    return sop_class.isin(uid_of("SegmentationStorage"), uid_of("LabelMapSegmentationStorage"))


def is_label_map(sop_class: Column) -> Column:
    return sop_class == F.lit(uid_of("LabelMapSegmentationStorage"))


def is_private(tag: Column) -> Column:
    return F.shiftright(tag, 16) % 2 == 1


def is_group_length(tag: Column) -> Column:
    return tag.bitwiseAND(F.lit(0xFFFF)) == 0


def in_file_meta(tag: Column) -> Column:
    return F.shiftright(tag, 16) == 2


def vr_in(vr: Column, names: list[str]) -> Column:
    return vr.isin(names)


def with_keywords(elements: DataFrame) -> DataFrame:
    """Dictionary join of a table with tag_hex: keyword and dictionary_vr, null if unknown."""
    d = dictionary(elements.sparkSession).select(F.col("tag_hex").alias("_t"), F.col("keyword"), F.col("vr").alias("dictionary_vr"))
    return elements.join(F.broadcast(d), F.col("tag_hex") == F.col("_t"), "left").drop("_t")
