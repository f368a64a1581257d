"""Set similarity, diversity sampling and threshold clustering as Spark plans."""
