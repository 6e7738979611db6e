"""Sources and sinks: catalogs, token lists, media folders, reports and frozen datasets."""
