"""Schemas of the tables that readers make and writers take. Order is data: every table has an ordinal."""

ARG = "struct<kind:string,i:int,s:string>"
ARC_ENTRY = "arc string, k int, name string, start int, len int, payload binary"
SCRIPT_OP = f"file string, op_idx int, ori_pos int, type int, args array<{ARG}>"
PO_ENTRY = "file string, entry_idx int, msgid string, msgstr string, comments array<string>"
ACME_ENTRY = "file string, id int, put_idx int, original string, text string, comments array<string>"
IMAGE = "path string, width int, height int, bpp int, codec string, pixels binary"
