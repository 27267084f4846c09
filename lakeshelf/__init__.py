"""A Spark-native shelf for collections of files and documents."""
