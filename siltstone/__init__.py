"""siltstone: DataFrame-to-DataFrame operators for collections of long documents and their annotations."""
