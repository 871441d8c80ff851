"""Sources: word-processor files of scans, PDF pages, images, folders, and what recognisers leave behind."""
