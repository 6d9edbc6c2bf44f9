"""DDL strings handed to from_xml: the raw inner-XML view and the text-parts view of <seg>."""

TU_RAW_DDL = "tuv array<struct<`_xml:lang`: string, seg: string>>, _corrupt_record string"
TU_PARTS_DDL = "tuv array<struct<`_xml:lang`: string, seg: struct<_VALUE: array<string>>>>"
