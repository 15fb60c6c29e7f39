"""Receipt analytics on Spark: set-at-a-time operators over the text lines of money-transfer receipts."""
