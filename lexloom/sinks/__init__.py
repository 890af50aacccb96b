"""Writers: rows to files and blobs."""
