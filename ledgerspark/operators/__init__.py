"""DataFrame -> DataFrame operators over journals and ledgers."""
