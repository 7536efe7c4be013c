from dunning.cli import main

raise SystemExit(main())
