"""Files in and out, and tables kept between jobs."""
