"""itemforge: item-name matching and catalogue analytics expressed as Spark plans."""
