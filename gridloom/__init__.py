"""gridloom: labelled-image dataset curation, augmentation and evaluation as Spark jobs."""
