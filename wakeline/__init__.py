"""Maritime surveillance and slick attribution as set-based Spark jobs."""
