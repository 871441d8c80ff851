"""Schemas of the tables between stages. Order is data: every table has its index columns."""

BOX = "ARRAY<DOUBLE>"  # x0, y0, x1, y1
ERROR = "STRUCT<code: STRING, message: STRING>"
LINE = f"STRUCT<text: STRING, box: {BOX}, score: DOUBLE>"
BLOCK = f"STRUCT<label: STRING, content: STRING, bbox: {BOX}>"
ASSET = "STRUCT<reference: STRING, source_path: STRING>"
ENGINE = "STRUCT<name: STRING, recognition_model: STRING, device: STRING>"
RASTER = "STRUCT<width: INT, height: INT, data: BINARY>"  # RGB, row by row
LAYOUT_BLOCK = f"STRUCT<bbox: {BOX}, ord: DOUBLE, type: STRING, markdown: STRING, content: STRING, asset_path: STRING, alt: STRING>"

SHEETS = f"doc_id STRING, sheet_number INT, name STRING, source_name STRING, content BINARY, page_layout STRING, pdf_page_number INT, error {ERROR}"
RASTERS = f"doc_id STRING, page_number INT, sheet_number INT, side STRING, source_image STRING, source_document STRING, pdf_page_number INT, page_layout STRING, source_width INT, source_height INT, split_column INT, image BINARY, error {ERROR}"
PREPARED = f"page_png BINARY, recovery_png BINARY, page_width INT, page_height INT, recovery_width INT, recovery_height INT, error {ERROR}"
RECOGNIZED = f"markdown STRING, layout_blocks ARRAY<{LAYOUT_BLOCK}>, raw_lines ARRAY<{LINE}>, fallback_lines ARRAY<{LINE}>, structure_blocks ARRAY<{BLOCK}>, table_cell_boxes ARRAY<{BOX}>, assets ARRAY<{ASSET}>, warnings ARRAY<STRING>, engine {ENGINE}, error {ERROR}"
SIDECAR = "overall_ocr_res STRUCT<rec_texts: ARRAY<STRING>, rec_boxes: ARRAY<ARRAY<DOUBLE>>, rec_scores: ARRAY<DOUBLE>>"
