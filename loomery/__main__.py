from loomery.cli import main

main()
