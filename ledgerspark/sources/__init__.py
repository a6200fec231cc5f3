"""Sources: journal files (CSV, workbooks), previews, the test-table adapter."""
